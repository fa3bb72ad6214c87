"""A tool's notice is seen behind a licence of any length."""

from strataloom.llm import vendored


def test_notice_behind_a_long_licence():
    licence = "// Redistribution and use in source and binary forms are permitted.\n" * 45
    assert vendored.notice(licence + "// Code generated by protoc-gen-go. DO NOT EDIT.\npackage a\n")
    assert not vendored.notice(licence + "package a\n")
