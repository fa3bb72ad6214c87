"""Residue on texts that were written after the phrase lists and not used to extend them."""

import pytest

from strataloom.llm import residue

EXCLUDED = [
    "Error 404\nThe page you requested was not found on this server.", "Forbidden\n\nYou don't have permission to access /admin/ on this server.", "Oops! Something went wrong. Please try again later.", "HTTP ERROR 500\n\nInternal Server Error", "This site can't be reached\nexample.org took too long to respond.\nERR_TIMED_OUT",
    "503 Service Unavailable\nNo server is available to handle this request.", "Your session has expired. Please log in again.", "Checking your browser before accessing example.org. Please wait.", "Please verify you are human to continue.", "Error establishing a database connection", "429 Too Many Requests", "Seite nicht gefunden. Die angeforderte Seite existiert nicht.", "Accès refusé. Vous n'avez pas les droits nécessaires.", "Error interno del servidor. Inténtelo más tarde.", "サーバーエラーが発生しました。しばらくしてからお試しください。", "Произошла ошибка. Попробуйте позже.",
    "Please enable JavaScript to continue using this application.", "This website requires JavaScript. Enable it and reload.", "JavaScript is required to view this page.", "Bitte aktivieren Sie JavaScript in Ihrem Browser.", "Veuillez activer JavaScript pour continuer.",
    "Dear {{customer_name}}, thank you for your order.", "Hi %FIRST_NAME%, your invoice is ready.", "Best regards,\n[Your Name]", "Welcome to ${company.name}! We are glad that you are here.", "Hello <%= user.first %>, please confirm your address.", "Owner: [INSERT TEAM] - reviewed last month.", "Dear undefined, we received your request.",
    "Lorem ipsum dolor sit amet, consectetur adipiscing elit. Sed do eiusmod tempor.", "About us\n\nUt enim ad minim veniam, quis nostrud exercitation ullamco laboris.", "Our story\n\nYour text goes here.", "Blindtext: hier steht Ihr Text.",
]
KEPT = [
    "In this note we describe the {0} syntax.", "Lorem ipsum dolor sit amet is the classic opening used by printers, as historians note.", "The server returns 404 when a record is missing and 403 when the caller lacks the role.", "We fixed a bug where an internal server error was shown after the session had expired and the cache was cold.", "To test without JavaScript, turn scripts off in the browser's settings and load the page; the list is rendered on the server.", "The placeholder {{ name }} is replaced when the mail is sent.", "A template such as \"Dear {{name}}\" is compiled once.", "Use `${HOME}` for the user's folder.",
    "Set the variable ${TOKEN} before the script runs.", "The word undefined appears in the log when a field is absent.", "Designers fill pages with dummy text until the copy is written, which hides problems of length.", "Null values are sorted last unless the query says otherwise.", "Retry with a delay if you see \"Too many requests\"; the limit is 60 calls a minute.", "for i in range(10):\n    print('{0}'.format(i))", "The gateway timeout was raised from 30 to 60 seconds because uploads of large files failed.", "| code | meaning |\n|-|-|\n| 404 | page not found |\n| 500 | internal server error |\n\nThe table lists what clients must handle, with the retry policy of each code explained below in detail.",
    "Die Seite beschreibt, wie Fehler 404 behandelt werden und welche Meldung der Nutzer sieht.", "Le serveur renvoie une erreur 500 si la base est arrêtée ; le client réessaie trois fois.", "Access to the archive was denied to the press for years, the court found in its ruling.", "Our captcha asks visitors to prove that they are not robots, which lowers spam by half.",
]


def test_precision_and_recall_on_held_out_texts():
    found = [bool(residue.classify(t)) for t in EXCLUDED]
    wrong = [t for t in KEPT if residue.classify(t)]
    missed = [t for t, f in zip(EXCLUDED, found) if not f]
    precision, recall = sum(found) / max(1, sum(found) + len(wrong)), sum(found) / len(found)
    print(f"precision {precision:.2f}, recall {recall:.2f}; wrong {wrong}; missed {missed}")
    assert precision >= 0.9 and recall >= 0.8


@pytest.mark.parametrize("text", KEPT[:2])
def test_explanations_stay(text):
    assert residue.classify(text) is None
