"""Credentials embedded in code, documents and commits: found by a trained score, and masked in place.

Candidate values are cut out wherever a credential may stand: in quotes (also quoted parts put together), after an equals
sign or colon, in an address or its parameters, after an authorisation scheme, after a word like password, as a long word
of mixed characters, or as a key block. A logistic regression scores each by how unlikely its characters are under a
Markov model of the corpus, by the ratio of its likelihoods under Markov models of labelled credentials and of labelled
others, by its shape, by the words of the identifier beside it (learnt, one weight a word), by where it stands and by its
path. Weak labels come from patterns that speak clearly for or against; the patterns are no features, and nothing overrules the
score. It is calibrated (Platt) on the scores of held-out folds and cut at ``THRESHOLD``. Markov counts are taken over all
contents; the regression sees at most ``SAMPLE`` candidates of at most ``TRAINED`` characters.

Candidates are staged sealed, under a key that only the driver and its tasks hold in memory.

Defined results: null and empty contents have none; a value counts on the line where it starts, in every row that holds it;
repeated rows count once in (id, line_no); without labelled values of both kinds nothing can be learnt, and nothing is found;
with fewer than two distinct ones of a kind nothing can be held out, and scores stay uncalibrated; masked contents keep their
length, line ends and all other characters.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import math
import os
import re
from collections import Counter
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataloom.session import stage_table

SAMPLE, THRESHOLD, RIDGE = 20_000, 0.5, 0.02
SALTS, SHRINK = 8, 10.0
BLOCK, BLOCK_CHARS = 4_096, 1_000_000  # rows, and characters of values or contents, that are worked on at once
BLOB = 100  # characters from which a value beside no word of secrets is labelled as data
FOLDS, VOCABULARY = 3, 200  # of the calibration; words beside values that have a weight
# Characters of a value beyond which it isn't trained on, so that the driver's sample stays bounded; it is judged whole all the same.
TRAINED = 4_000

# Words beside a value that label it: of secrets, and of things that aren't.
SECRET = {"password", "passwort", "passwd", "pass", "pwd", "passphrase", "secret", "token", "key", "apikey", "auth", "authorization", "credential", "credentials", "creds", "cred", "sig", "signature", "psk", "dsn"}
STRONG = {"password", "passwort", "passwd", "pass", "pwd", "passphrase", "secret", "apikey"}
PLAIN = {"header", "headers", "name", "label", "field", "id", "uuid", "guid", "etag", "integrity", "checksum", "hash", "sha", "sha1", "sha256", "sha512", "md5", "revision", "public", "version", "placeholder", "help", "example", "nonce", "param", "base64"}
# Values that stand in for one.
_STAND_IN = re.compile(
    r"""(?ix)^(?:.{0,3}|(.)\1{3,}.*|[*•x.\-_\#]+|<.*>|\{.*\}|\$\{?\(?[a-z_][\w.]*\)?\}?|%[a-z_]\w*%?|\[.*\]|.*\$\{.*|.*\{\{.*|@@.*|your.*|(?:my|the|a|some|insert|enter|add|put|set|use|replace|choose)[-_\ ](?:your|my|the|a|some|new|real|own|here|with|this|it|password|passwd|secret|token|key|value|api)\b.*
      |(?:[a-z]+[-_\ ])*(?:change[-_]?me|replace[-_]?me|placeholder|redacted|dummy|todo|fixme|tbd|goes[-_]here)(?:[-_\ ][a-z]+)*|.*example(?:key|secret|token|password)?|password\d{0,4}|passw(?:or)?d|secret|token|test|testing|none|null|nil|undefined|true|false|empty|string|username|admin|authorization|x-[a-z-]+|(?:api|access|auth|session)[-_]?(?:key|token)
      |os\.environ.*|process\.env.*|env[.:].*|vault:.*|secret(?:s|ref)?[:/].*|ref[:+].*|arn:aws:(?:secretsmanager|ssm|kms):.*|keychain:.*|op://.*)$"""
)
_KNOWN = re.compile(
    r"""(?x)^(?:AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{40,}|glpat-[\w-]{16,}|xox[abposr]-[\w-]{20,}|(?:sk|rk|pk)_(?:live|test)_[A-Za-z0-9]{16,}|whsec_\w{20,}|sk-(?:[a-z]+-)*[A-Za-z0-9_-]{20,}|AIza[\w-]{30,}|ya29\.[\w-]+|SG\.[\w-]{16,}\.[\w-]{16,}|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{30,}|dop_v1_[0-9a-f]{40,}|hvs\.[\w-]{20,}|eyJ[\w-]{8,}\.eyJ[\w-]{8,}\.[\w-]{10,}|SK[0-9a-f]{32}|AC[0-9a-f]{32}|key-[0-9a-f]{32}|[0-9]{8,10}:AA[\w-]{33})$"""
)
_HASHLIKE = re.compile(r"(?i)^(?:sha\d+-.*|sha\d*:.*|md5[-:].*|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})$")
_HEX = re.compile(r"(?i)^[0-9a-f]{24,}$")

_QUOTED = r"'(?:[^'\\\n]|\\.)*+'|\"(?:[^\"\\\n]|\\.)*+\"|`[^`\\\n$]*+`"
_STRING, _GLUE, _LISTED = re.compile(_QUOTED), re.compile(r"\s*+[+,.]?\s*+(?:\\\n\s*+)?"), re.compile(r"\s*\]\s*\.(?:concat|join)")
_TAIL = re.compile(r"\s*(?:\]\s*\.(?:concat|join)|[;,)\]}\n]|$)")
# Quotes, and passwords in addresses, are only begun by the pattern; ``_matches`` follows them to their end in linear time.
_OTHERS = r"""
    (?P<block>-----BEGIN[ ][A-Z0-9 ]+-----)
    |(?P<login>(?:-u|--user)[ =]+['"]?[\w.@\-]+:(?P<lval>[^\s'"]{4,}))
    |@userinfo@(?P<param>[?&](?P<pname>[A-Za-z_][\w\-.]*)=(?P<pval>[^&\s'"`<>)\]]{6,}))
    |(?P<scheme>(?i:\b(?:bearer|basic|digest|token|apikey))[ ]+(?P<sval>[A-Za-z0-9+/=._~\-]{8,}))
    |(?P<quoted>['"`])
    |(?P<said>(?i:\b(?:pass(?:word|phrase|code)|passwort|kennwort|contraseña|mot\ de\ passe|secret|token|api[- ]key|key|pin))[ ]+(?:(?i:is|was|of|ist|=|:)[ ]+)?(?P<said_val>(?![^\s]*[^!-~\s])[^\s'"`]{6,}))
    |(?P<set>(?<![\w.\-])(?P<sname>[A-Za-z_][\w.\-]*+)[ \t]*+(?:=|:=|:)[ \t]*(?P<setval>(?!//|\d+/|(?i:bearer|basic|token|apikey)\b)[^\s&'"`,;(){}\[\]<>][^\s'"`,;(){}<>]{5,})(?=[\s;,]|$))
    |(?P<word>(?<![\w/+=.\-])(?=[\w+/=\-]*\d)(?=[\w+/=\-]*[A-Za-z])[A-Za-z0-9/+][\w+/=.\-]{15,})
"""
_FIND = re.compile("(?x)" + _OTHERS.replace("@userinfo@", """(?P<userinfo>(?<![\\w+.\\-])[a-zA-Z][\\w+.\\-]*+://[^\\s:/@'"`<>]*+:(?=[^\\s@'"`]))|"""))
_NO_URL = re.compile("(?x)" + _OTHERS.replace("@userinfo@", ""))
# Where a candidate may begin: every place at which ``_FIND`` matches, and few others. The inside of a word is passed at once. Like
# there, what reads on without bound does so only where a run begins.
_START = re.compile(
    r"""(?x)[A-Za-z0-9_\u017f\u212a'"`?&/+\-](?<!\w\w)(?:
      (?<=\w)(?:
        (?<![.\-].)[\w.\-]*+(?:\+|://|[ \t]*+[=:]=?[ \t]*[^\s&'"`,;(){}\[\]<>][^\s'"`,;(){}<>]{5})
        |(?<![+/=.\-].)[\w+/=.\-]{15}
        |(?<=[bBdDtTaApPkKcCmMsS\u017f\u212a])[aAeEiIoOpP\u0130\u0131](?i:arer|sic|gest|ken|i[- ]?key|ss(?:word|wort|phrase|code)|nnwort|ntraseña|t\ de\ passe|cret|y|n)[ ])
      |(?<=['"`])
      |(?<=[?&])[A-Za-z_]
      |(?<=[/+])(?<![\w/+=.\-].)[\w+/=.\-]{15}
      |(?<=-)(?:----BEGIN|u[ =]|-user[ =]))"""
)
_PW_END = re.compile(r"[\s@'\"`]|\Z")
# A key's lines may stand in quotes put together, in lists, and behind comment marks: the gaps between runs of base64.
_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]+-----")
_GAP = r"""(?:\\++[nrt]?|[\s'"`,.\#*;>%|!]|SLASH|\+(?=\s*+(?:[bBrRuUfF]{1,2})?['"`])|-(?=[A-Za-z0-9+/]|-----END)|[bBrRuUfF]{1,2}(?=['"]))"""
_RUN = r"[A-Za-z0-9+/=]"


def _key_patterns(slash: str):
    """The body of a key block up to its END line, or without one as far as long runs go; and its pieces. ``slash``: how // begins a comment."""
    gap = _GAP.replace("SLASH", slash)
    head = rf"(?:{gap}*+[A-Za-z][\w-]*+:[ ][^\n\\'\"`]*+)*+{gap}*+"
    end = r"-----END [A-Z0-9 ]+-----"
    body = rf"{head}(?P<body>{_RUN}{{16,}}+(?:{gap}++{_RUN}++)*+{gap}*+){end}|{head}(?P<open>{_RUN}{{16,}}+(?:{gap}++{_RUN}{{16,}}+)*+(?:{gap}++{_RUN}++\Z)?)"
    return re.compile(body), re.compile(rf"{gap}|(?P<run>{_RUN}++)")


_KEY = {False: _key_patterns(r"//++(?=[ \t\r\n])"), True: _key_patterns("//++")}
_CLOSING = re.compile(r"(?:\\+[nr])*['\"`]?")


def _key(text: str, m: re.Match) -> tuple[int, int, list[tuple[int, int]]] | None:
    """(start, end, spans of base64) of the key block that begins with ``m``; None where no key follows."""
    left = text[text.rfind("\n", 0, m.start()) + 1 : m.start()].strip()
    body, pieces = _KEY[left.endswith("//")]
    found = body.match(text, m.end())
    if not found:
        return None
    return m.start(), found.end(), [p.span("run") for p in pieces.finditer(text, *found.span(found.lastgroup)) if p.group("run")]


# A name is begun at its first letter only, where the leftmost match begins.
_TARGET = re.compile(r"([A-Za-z_$](?<![A-Za-z_$].)[\w$.\-]*)['\"`]?\]?\s*(?:\??:\s*[\w<>\[\]&' |.]+?)?\s*(?::=|=>|===?|[=:(,]|\|\||\?\?|\bor\b)\s*(?:&|b|r|f|String::from\(|\[)?\s*$")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_DATA, _DATA_LEFT = re.compile(r"(?i)data:[\w+.\-]+/[\w+.\-]+[;,]"), re.compile(r"(?i)data:[\w+.\-]+/[\w+.\-]+(?:;[\w=.\-]+)*,$")
_PUBLIC = re.compile(r"(?i)example\.(?:com|org)|localhost\b")


def words_of(name: str) -> list[str]:
    return [w.lower() for w in _WORDS.findall(name)]


def _next(text: str, at: int) -> re.Match | None:
    """``_FIND.search(text, at)``, tried at likely places only."""
    while start := _START.search(text, at):
        if m := _FIND.match(text, start.start()):
            return m
        at = start.start() + 1
    return None


def _matches(text: str):
    """(match, kind, start, end, spans of the quoted parts or of a key's base64) in order; for a password in an address, its own start and end.

    Linear: each end of a password and each chain of quoted parts is looked for once.
    """
    at, pw_end, no_close, single, keys = 0, -1, {}, set(), {}
    for m in _BEGIN.finditer(text):
        if key := _key(text, m):
            keys[m.start()] = key
    order = sorted(keys)
    while m := _next(text, at):
        kind = m.lastgroup  # the outer one closes last
        if kind == "userinfo":
            if pw_end < m.end():
                pw_end = _PW_END.search(text, m.end()).start()
            if text[pw_end : pw_end + 1] == "@":
                yield m, kind, m.end(), pw_end, []
                at = pw_end + 1
                continue
            a, m = m.start(), _NO_URL.match(text, m.start())
            if not m:
                at = a + 1
                continue
            kind = m.lastgroup
        a, b = m.span()
        if kind == "block":
            key = keys.get(a)
            yield m, kind, a, key[1] if key else b, key[2] if key else []
            at = _CLOSING.match(text, key[1]).end() if key else b
            continue
        if kind != "quoted":
            yield m, kind, a, b, []
            at = max(b, a + 1)
            continue
        parts, good = [], 0
        while text[a : a + 1] in ("'", '"', "`") and a < len(text):
            sign = text[a]
            if a < no_close.get(sign, -1):  # this line has no further closing one
                break
            m2 = _STRING.match(text, a)
            if not m2:
                stop = text.find("\n", a)
                if sign != "`":
                    no_close[sign] = len(text) if stop < 0 else stop
                break
            k = bisect.bisect(order, a)
            if k < len(order) and order[k] < m2.end():  # it holds a key, which is read as such
                break
            parts.append(m2.span())
            if parts[0][0] in single:
                break
            if _TAIL.match(text, m2.end()):
                good = len(parts)
            a = _GLUE.match(text, m2.end()).end()
        if not parts:
            at = b
            continue
        if len(parts) > 1:  # parts behind the last good end are on their own
            single.update(x for x, _ in parts[max(good, 1) :])
        parts = parts[: good if good > 1 else 1]
        yield m, "joined" if len(parts) > 1 else "quoted", parts[0][0], parts[-1][1], parts
        at = parts[-1][1]


def candidates(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, value, words left of it) of every candidate, in order."""
    out = []
    for m, kind, a, b, parts in _matches(text):
        if kind == "block":  # of any sort, since its lines are no words; only private keys count
            if parts and "PRIVATE KEY" in m.group():
                out.append((a, b, kind, "".join(text[x:y] for x, y in parts), ""))
            continue
        left = text[max(0, a - 80) : a].rpartition("\n")[2]
        if kind == "userinfo":
            out.append((a, b, kind, text[a:b], "url"))
        elif kind == "login":
            out.append((m.start("lval"), m.end("lval"), kind, m.group("lval"), "login password"))
        elif kind == "param":
            out.append((m.start("pval"), m.end("pval"), kind, m.group("pval"), m.group("pname")))
        elif kind == "scheme":
            out.append((m.start("sval"), m.end("sval"), kind, m.group("sval"), "auth " + left[-24:]))
        elif kind == "said":
            value = m.group("said_val").rstrip(".,;:!?)") if not m.group("said_val").endswith("!") else m.group("said_val")
            out.append((m.start("said_val"), m.start("said_val") + len(value), kind, value, m.group("said").split()[0]))
        elif kind == "set":
            out.append((m.start("setval"), m.end("setval"), kind, m.group("setval"), m.group("sname")))
        elif kind == "word":
            if _DATA_LEFT.search(left):
                continue
            value = m.group().rstrip(".-=") if not m.group().endswith("==") else m.group()
            out.append((a, a + len(value), kind, value, left[-40:]))
        else:
            target = _TARGET.search(left)
            name = target.group(1) if target else ""
            if target and left[: target.start(1)].rstrip().endswith(("environ.get", "getenv", "env", "Getenv", "get")):
                name = "env " + name
            # A default of a lookup belongs to the looked-up name: get('X_KEY', 'value').
            if kind == "joined":
                glue = "".join(text[x:y] for (_, x), (y, _) in zip(parts, parts[1:]))
                if "+" in glue or _LISTED.match(text, b) or not glue.strip(" \t\n\\"):
                    value = "".join(text[x + 1 : y - 1] for x, y in parts)
                    out += _inner(text, a, b, kind, value, name)
                else:
                    prior = name
                    for x, y in parts:
                        out += _inner(text, x, y, "quoted", text[x + 1 : y - 1], prior if prior == name else name + " " + prior)
                        prior = text[x + 1 : y - 1]
            else:
                out += _inner(text, a, b, kind, text[a + 1 : b - 1], name)
    return out


def _inner(text: str, a: int, b: int, kind: str, value: str, name: str):
    """A quoted value, or what stands in it: an address, a scheme, a sentence."""
    if len(value) < 4 or _DATA.match(value):  # a data address holds content
        return
    if kind == "quoted" and ("://" in value or " " in value.strip() or "=" in value[:-2]):
        for m, k, x, y, _ in _matches(value):
            group, label = {"login": ("lval", "login password"), "param": ("pval", k == "param" and m.group("pname") or ""), "scheme": ("sval", "auth " + name), "said": ("said_val", "password"), "set": ("setval", (k == "set" and m.group("sname") or "") + " " + name), "word": ("word", name)}.get(k, (None, "url"))
            if group:
                x, y = m.span(group)
            if group or k == "userinfo":
                yield a + 1 + x, a + 1 + y, k, value[x:y], label
        if "://" in value or "=" not in value:
            return
    if not any(c.isspace() for c in value):
        yield a + (kind == "quoted"), b - (kind == "quoted"), kind, value, name


# --- Markov models

_N = 97
_CODE = bytes(min(max(b - 31, 0), _N - 1) for b in range(256))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii", "replace").translate(_CODE), dtype=np.uint8)


def _pairs(codes: np.ndarray) -> np.ndarray:
    return codes[:-1].astype(np.uint16) * _N + codes[1:]


def count_pairs(text: str, counts: np.ndarray) -> None:
    """Adds the character pairs within the words of ``text``."""
    n = np.bincount(_pairs(_codes(text)), minlength=_N * _N).reshape(_N, _N)
    n[:2] = n[:, :2] = 0
    counts += n.ravel()


class Values:
    """Values in one row of codes, with an edge (code 0) before, between and behind them, so that arrays serve all of them at once."""

    def __init__(self, values: list[str]):
        self.values, self.n = values, np.array([len(v) for v in values])
        self.codes = _codes("\x1f".join(["", *values, ""]))
        self.pairs = _pairs(self.codes)  # a value has one more than characters, those with its edges
        self.row = np.repeat(np.arange(len(values)), self.n + 1)
        self.first = np.cumsum(self.n + 1) - self.n - 1

    def sums(self, log: np.ndarray, inner: bool = False) -> np.ndarray:
        """Of ``log`` over the pairs of each value, with its edges or without."""
        each = log.ravel()[self.pairs]
        if inner:
            each[self.first] = each[self.first + self.n] = 0.0
        return np.add.reduceat(each, self.first)

    @cached_property
    def times(self) -> np.ndarray:
        """How often each value has each code."""
        times = np.bincount(self.row * _N + self.codes[1:], minlength=len(self.n) * _N).reshape(-1, _N)
        times[:, 0] -= 1  # the edge
        return times

    @cached_property
    def forms(self) -> np.ndarray:
        """Has letters, has signs, has both cases."""
        return np.array([(low != (up := v.upper()), not v.isalnum(), low != v != up) for v in self.values for low in (v.lower(),)], dtype=float)


def _cuts(values: list[str]):
    """Slices of ``values`` in order, of up to ``BLOCK`` values and about ``BLOCK_CHARS`` characters, which bound the arrays."""
    first = chars = 0
    for i, v in enumerate(values):
        if i > first and (i - first >= BLOCK or chars + len(v) > BLOCK_CHARS):
            yield slice(first, i)
            first, chars = i, 0
        chars += len(v)
    if values:
        yield slice(first, len(values))


class Markov:
    """Log-probability of a character after another, from pair counts with additive smoothing."""

    def __init__(self, counts: np.ndarray):
        m = counts.reshape(_N, _N).astype(np.float64) + 0.5
        self.log = np.log(m / m.sum(axis=1, keepdims=True))

    def mean(self, v: Values) -> np.ndarray:
        return np.where(v.n > 1, v.sums(self.log, inner=True) / np.maximum(v.n - 1, 1), -4.0)


class Ratio:
    """Log-ratio of likelihoods under Markov models of labelled credentials and of the others (values have an edge at both ends), and the
    log-odds of the words beside them; and how the two go together."""

    def __init__(self, values: list[str], beside_each: list[set[str]], y: np.ndarray):
        m = np.full(2 * _N * _N, 0.3)
        for cut in _cuts(values):
            v, side = Values(values[cut]), y[cut].astype(int) * _N * _N
            each = np.minimum(1.0, 20 / (v.n + 1))  # a long value counts as 20 characters
            m += np.bincount(side[v.row] + v.pairs, each[v.row], 2 * _N * _N)
        m = m.reshape(2, _N, _N)
        beside = [Counter(), Counter()]
        for words, label in zip(beside_each, y):
            beside[int(label)].update(words)
        log = np.log(m / m.sum(axis=2, keepdims=True))
        self.log = log[1] - log[0]
        n = [len(y) - float(y.sum()), float(y.sum())]
        rate = {w: (beside[0][w] + beside[1][w]) / len(y) for w in beside[0].keys() | beside[1].keys()} if len(y) else {}
        # Each class's rate of a word is drawn to the common one as if SHRINK more rows had shown that.
        self.odds = {w: math.log((beside[1][w] + SHRINK * r) / (n[1] + SHRINK)) - math.log((beside[0][w] + SHRINK * r) / (n[0] + SHRINK)) for w, r in rate.items()}

    def of(self, v: Values, labels: list[str], beside: dict[str, set[str]]) -> np.ndarray:
        sums = v.sums(self.log)
        mean, total = sums / (v.n + 1), np.clip(sums / 10, -6.0, 6.0)
        of_label = {w: min(6.0, max(-6.0, sum(self.odds.get(x, 0.0) for x in beside[w]))) for w in set(labels)}
        odds = np.array([of_label[w] for w in labels])
        kinds = v.forms.sum(axis=1) + (v.times[:, 17:27].sum(axis=1) > 0)  # of characters
        return np.stack([mean, total, odds, odds * mean, odds * total / 6, odds * kinds / 4, kinds / 4], axis=1)


# --- features and weak labels

_READABLE = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}")


def _decoded(value: str) -> bool:
    """Base64 of user:password."""
    try:
        raw = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode("ascii")
    except (binascii.Error, ValueError):
        return False
    user, colon, pw = raw.partition(":")
    return bool(colon and user.isprintable() and len(pw) > 3 and not _STAND_IN.match(pw))


def odd(value: str) -> bool:
    """Letters with digits or signs: the look of a chosen or random secret."""
    has = [any(c.isdigit() for c in value), any(c.isalpha() for c in value), any(not c.isalnum() and c not in "_-./:" for c in value), any(c.isupper() for c in value) and any(c.islower() for c in value)]
    return has[1] and (has[0] or has[2]) and sum(has) >= 2


def weak_label(kind: str, value: str, label: str) -> int | None:
    """1 or 0 where a pattern speaks clearly, else None."""
    words = set(words_of(label))
    plain, secret, strong = bool(words & PLAIN), bool(words & SECRET), bool(words & STRONG) or {"api", "key"} <= words
    if _STAND_IN.match(value) or _HASHLIKE.match(value) or label.startswith("env "):
        return 0
    if kind in ("block", "userinfo", "login") or _KNOWN.match(value):
        return 1
    if kind == "scheme":
        return 1 if _decoded(value) or _HEX.match(value) or odd(value) and len(value) >= 16 else 0 if value.isalpha() and value.islower() else None
    if strong and not plain and odd(value) and len(value) >= 8:
        return 1
    if secret and not plain and odd(value) and len(value) >= 20:
        return 1
    if kind == "param":
        return 1 if secret and odd(value) else 0
    if secret and not plain:
        return None if odd(value) else 0
    if plain or not odd(value) or _HEX.match(value) or len(value) < 16 or sum(map(len, _READABLE.findall(value))) >= 0.6 * len(value):
        return 0
    return 0 if len(value) >= BLOB and not secret else None  # a long odd value beside no word that speaks


_PLACES = ("userinfo", "login", "block", "scheme", "param", "joined", "said", "set", "word")
_HEXED = re.compile(r"[0-9a-fA-F-]*\Z")


def _shape(kinds: list[str], v: Values, paths: list[str], markov: Markov) -> np.ndarray:
    n, some, times = v.n, np.maximum(v.n, 1), v.times
    unlikely = -markov.mean(v) - 3.0
    row, code = np.nonzero(times)
    share = times[row, code] / some[row]
    places = {k: [float(k == x) for x in _PLACES] for k in set(kinds)}
    of_path = {p: [float("test" in low), float(low.endswith((".md", ".txt", ".rst"))), float(p == "")] for p in set(paths) for low in (p.lower(),)}
    looks = [(x.replace("-", "").replace("_", "").replace(".", "").replace("/", "").isalpha(), bool(_HEXED.match(x))) for x in v.values]
    return np.concatenate([
        np.stack([np.ones(len(n)), unlikely, unlikely * np.minimum(n, 40) / 20, -np.bincount(row, share * np.log2(share), len(n)) - 3.0, np.minimum(n, 64) / 16 - 1, np.log2(np.maximum(n, 64)) - 6, times[:, 17:27].sum(axis=1) / some, v.forms[:, 2], v.forms[:, 1], times[:, 16] > 0, times[:, 15] > 1], axis=1),
        np.array(looks, dtype=float), (np.count_nonzero(times, axis=1) / np.maximum(np.minimum(n, 30), 1))[:, None], np.array([places[k] for k in kinds]), np.array([of_path[p] for p in paths]),
    ], axis=1)


def _beside(label: str) -> set[str]:
    return {*words_of(label), *(["(env)"] if label.startswith("env ") else [])}


class Features:
    """What the regression sees of a candidate: its shape, its likelihood ratios, and which of the frequent words stand beside it."""

    def __init__(self, markov: Markov, ratio: Ratio, vocabulary: dict[str, int]):
        self.markov, self.ratio, self.vocabulary = markov, ratio, vocabulary

    def of(self, rows: list[tuple[str, str, str, str]]) -> tuple[np.ndarray, list[list[int]]]:
        """Shapes and ratios, and the places of the frequent words."""
        kinds, values, labels, paths = (list(c) for c in zip(*rows))
        v, beside = Values(values), {w: _beside(w) for w in set(labels)}
        at = {w: [self.vocabulary[x] for x in words if x in self.vocabulary] for w, words in beside.items()}
        return np.concatenate([_shape(kinds, v, paths, self.markov), self.ratio.of(v, labels, beside)], axis=1), [at[w] for w in labels]


class Model:
    """Weights of the regression and of its calibration, with the features' models; without weights nothing scores."""

    def __init__(self, features: Features | None, weights: np.ndarray | None = None, slope: float = 1.0, shift: float = 0.0):
        self.features, self.weights, self.slope, self.shift = features, weights, slope, shift

    def raw(self, rows: list[tuple[str, str, str, str]]) -> np.ndarray:
        z = []
        for cut in _cuts([r[1] for r in rows]):
            x, beside = self.features.of(rows[cut])
            each = self.weights[x.shape[1] :]
            z.append(x @ self.weights[: x.shape[1]] + np.array([sum(each[at] for at in places) for places in beside]))
        return np.concatenate(z)

    def score(self, rows: list[tuple[str, str, str, str]]) -> np.ndarray:
        """Calibrated probability of (kind, value, label, path) rows."""
        if not rows or self.weights is None:
            return np.zeros(len(rows))
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(rows) + self.shift, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, ridge: float, alike: bool = True, start: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression by damped Newton steps, classes weighted alike or as they come."""
    each = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y) if alike else np.ones(len(y))
    sign = 2 * y - 1

    def loss(w: np.ndarray) -> float:
        return float(each @ np.logaddexp(0.0, -sign * (x @ w)) + 0.5 * ridge * w @ w)

    w = np.zeros(x.shape[1]) if start is None else start.copy()
    now = loss(w)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        g = x.T @ (each * (p - y)) + ridge * w
        h = (x * (each * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step, size = np.linalg.solve(h, g), 1.0
        # A whole step may overshoot where the sigmoid is flat: it is halved until the loss falls.
        while (then := loss(w - size * step)) > now - 1e-4 * size * float(g @ step) and size > 1e-10:
            size /= 2
        if then >= now:
            break
        w, gained, now = w - size * step, now - then, then
        if gained < 1e-7 * max(now, 1e-9):
            break
    return w


class Labelled:
    """Labelled rows with what every fold sees alike of them."""

    def __init__(self, rows: list, y: np.ndarray, markov: Markov, vocabulary: dict[str, int]):
        self.y, self.values, self.labels = y, [r[1] for r in rows], [r[2] for r in rows]
        self.beside = {w: _beside(w) for w in set(self.labels)}
        self.shape = np.concatenate([_shape([r[0] for r in rows[cut]], Values(self.values[cut]), [r[3] for r in rows[cut]], markov) for cut in _cuts(self.values)])
        self.words = np.zeros((len(rows), len(vocabulary)))
        for i, w in enumerate(self.labels):
            self.words[i, [vocabulary[x] for x in self.beside[w] if x in vocabulary]] = 1.0

    def ratio(self, use: np.ndarray) -> Ratio:
        return Ratio([self.values[i] for i in use], [self.beside[self.labels[i]] for i in use], self.y[use])

    def matrix(self, at: np.ndarray, ratio: Ratio) -> np.ndarray:
        values, labels = [self.values[i] for i in at], [self.labels[i] for i in at]
        ratios = np.concatenate([ratio.of(Values(values[cut]), labels[cut], self.beside) for cut in _cuts(values)])
        return np.concatenate([self.shape[at], ratios, self.words[at]], axis=1)


def _learn(data: Labelled, use: np.ndarray, values: np.ndarray, start: np.ndarray | None = None) -> tuple[Ratio, np.ndarray]:
    """Likelihood ratios and weights of the rows ``use``; each half of the values is seen through ratios of the other half, as unknown values will be."""
    half = values % 2 == 0
    parts = [(use[mine], data.matrix(use[mine], data.ratio(use[~mine]))) for mine in (half, ~half) if mine.any()]
    order = np.concatenate([at for at, _ in parts])
    return data.ratio(use), _fit(np.concatenate([x for _, x in parts]), data.y[order], RIDGE, start=start)


def train(sample: list[tuple[str, str, str, str]], markov: Markov) -> Model:
    """Fits on the weakly labelled rows, and calibrates on the scores that models of the other folds give to each fold."""
    labelled = sorted({r: y for r in sample if (y := weak_label(*r[:3])) is not None}.items())
    rows, y = [r for r, _ in labelled], np.array([float(v) for _, v in labelled])
    if not 0 < y.sum() < len(y):
        return Model(None)
    # A value is in one fold only; folds take turns within each class, in the order of hashes.
    rank = {v: i for label in (0, 1) for i, v in enumerate(sorted({r[1] for r, k in labelled if k == label}, key=lambda v: (xxhash.xxh64_intdigest(v), v)))}
    values = np.array([rank[r[1]] for r in rows])
    often = Counter(w for r in rows for w in _beside(r[2]))
    vocabulary = {w: i for i, (w, _) in enumerate(sorted(often.items(), key=lambda t: (-t[1], t[0]))[:VOCABULARY])}
    data = Labelled(rows, y, markov, vocabulary)
    ratio, weights = _learn(data, np.arange(len(y)), values)
    model = Model(Features(markov, ratio, vocabulary), weights)
    folds = min(FOLDS, *(len({r[1] for r, k in labelled if k == label}) for label in (0, 1)))
    if folds > 1:
        z = np.empty(len(y))
        for fold in range(folds):
            held = np.flatnonzero(values % folds == fold)
            use = np.flatnonzero(values % folds != fold)
            ratio, w = _learn(data, use, values[use] // folds, start=weights)  # the optimum is one, wherever the steps begin
            z[held] = data.matrix(held, ratio) @ w
        model.slope, model.shift = (float(v) for v in _fit(np.stack([z, np.ones(len(z))], axis=1), y, 1e-3, alike=False))
    return model


# --- over a table

_SEEN = "pair int, n bigint, id string, line_no int, kind string, sealed binary, path string, size int, rare boolean, h bigint, k1 bigint, k2 bigint, spans array<int>"
_RARE = re.compile(r"(?i)pass|pwd|secret|token|key|auth|cred|login")


def seal(text: str, key: bytes) -> bytes:
    """``text`` under ``key``; equal texts stay equal."""
    raw = text.encode("utf-8", "surrogatepass")
    tag = hashlib.blake2b(raw, key=key, digest_size=16).digest()
    stream = hashlib.shake_256(key + tag).digest(len(raw))
    return tag + (int.from_bytes(raw, "big") ^ int.from_bytes(stream, "big")).to_bytes(len(raw), "big")


def unseal(sealed: bytes, key: bytes) -> str:
    n = len(sealed) - 16
    stream = hashlib.shake_256(key + sealed[:16]).digest(n)
    return (int.from_bytes(sealed[16:], "big") ^ int.from_bytes(stream, "big")).to_bytes(n, "big").decode("utf-8", "surrogatepass")


def _opened(sealed: bytes, key: bytes) -> tuple[str, str]:
    label, _, value = unseal(sealed, key).partition("\0")
    return value, label


def _extract(key: bytes):
    def run(batches):
        counts = np.zeros(_N * _N, dtype=np.int64)
        schema = pa.schema([("pair", pa.int32()), ("n", pa.int64()), ("id", pa.string()), ("line_no", pa.int32()), ("kind", pa.string()), ("sealed", pa.binary()), ("path", pa.string()), ("size", pa.int32()), ("rare", pa.bool_()), ("h", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("spans", pa.list_(pa.int32()))])
        for batch in batches:
            rows, texts, chars = [], [], 0
            for i, path, text, k1, k2 in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if not text:
                    continue
                texts.append(text)
                chars += len(text)
                if chars > BLOCK_CHARS:
                    count_pairs(" ".join(texts), counts)
                    texts, chars = [], 0
                line, seen = 1, 0
                for a, b, kind, value, label in candidates(text):
                    line += text.count("\n", seen, a)
                    spans = [at for span in spans_of(text, a, b, kind) for at in span]
                    seen, label = a, label.replace("\0", " ")
                    rare = kind in ("block", "userinfo", "login", "scheme", "param", "said") or bool(_RARE.search(label))
                    h = xxhash.xxh64_intdigest(f"{kind}\0{label}\0{path}\0{value}".encode("utf-8", "surrogatepass")) - (1 << 63)
                    rows.append((None, None, i, line, kind, seal(f"{label}\0{value}", key), path or "", len(value) + len(label), rare, h, k1, k2, spans))
            count_pairs(" ".join(texts), counts)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)
        some = np.flatnonzero(counts)
        none = [None] * len(some)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(counts[some], pa.int64()), *[pa.array(none, t) for t in schema.types[2:]]], schema=schema)

    return run


def learn(chunks: DataFrame, sample: int = SAMPLE) -> tuple[Model, DataFrame, bytes]:
    """The model, the table of all candidates, and the key that it is sealed with."""
    key = os.urandom(32)
    seen = stage_table(chunks.select("id", "file_path", "content", *_content_key()).mapInArrow(_extract(key), _SEEN), "candidates")
    counts = np.zeros(_N * _N, dtype=np.int64)
    for pair, n in seen.where("pair is not null").groupBy("pair").agg(F.sum("n")).collect():  # at most 97 x 97 rows
        counts[pair] = n
    found = seen.where("pair is null")
    # Of candidates beside a secret's word or place, and of the others, the first by hash: at most ``sample`` rows.
    picked = found.where(F.col("size") <= TRAINED).select("rare", "h", "kind", "sealed", "path").distinct()
    drawn = picked.withColumn("nth", F.row_number().over(Window.partitionBy("rare").orderBy("h"))).where(F.col("nth") <= sample // 2)
    rows = []
    for r in drawn.select("kind", "sealed", "path").collect():
        value, label = _opened(bytes(r["sealed"]), key)
        rows.append((r["kind"], value, label, r["path"]))
    return train(rows, Markov(counts)), found, key


def _scored(model: Model, found: DataFrame, key: bytes, threshold: float, keep: str) -> DataFrame:
    """Rows of candidates that score at least ``threshold``, with ``score``; ``keep`` is the schema of the columns that stay."""
    names = [c.split()[0] for c in keep.split(", ")]

    def judge(batches):
        for batch in batches:
            kinds, sealed, paths = (batch.column(i).to_pylist() for i in range(3))
            opened = {x: _opened(x, key) for x in set(sealed)}  # equal ones once
            score = model.score([(k, *opened[x], p) for k, x, p in zip(kinds, sealed, paths)])
            some = pa.array(score >= threshold)
            yield pa.RecordBatch.from_arrays([*(batch.column(3 + i).filter(some) for i in range(len(names))), pa.array(score).filter(some)], [*names, "score"])

    columns = [F.col("kind").alias("__kind"), F.col("sealed").alias("__sealed"), F.col("path").alias("__path"), *names]
    return found.select(*columns).mapInArrow(judge, f"{keep}, score double")


def find(chunks: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(id, line_no, kind, score) of every value that scores at least ``threshold``."""
    model, found, key = learn(chunks, sample)
    return _scored(model, found, key, threshold, "id string, line_no int, kind string")


MASK = "x"  # stands in quotes, in addresses and as a plain word of any language or of YAML


def spans_of(text: str, a: int, b: int, kind: str) -> list[tuple[int, int]]:
    """What of a candidate is masked: of a key its base64, of quoted parts put together what is in the quotes."""
    if kind == "block":
        return _key(text, _BEGIN.match(text, a))[2]
    if kind == "joined":
        return [(a + m.start() + 1, a + m.end() - 1) for m in _STRING.finditer(text[a:b])]
    return [(a, b)]


def mask(text: str, path: str, model: Model, threshold: float) -> str:
    """``text`` with the characters of found values replaced by ``MASK``; line ends, quotes and length stay."""
    found = candidates(text)
    score = model.score([(k, v, w, path) for _, _, k, v, w in found])
    out = list(text)
    for (a, b, kind, _, _), p in zip(found, score):
        for lo, hi in spans_of(text, a, b, kind) if p >= threshold else []:
            for i in range(lo, hi):
                if out[i] not in "\r\n":
                    out[i] = MASK
    return "".join(out)


def _content_key() -> list:
    """Two hashes of a content, by which its found spans come back to it; equal contents of different paths are told apart."""
    return [F.xxhash64("content", F.coalesce("file_path", F.lit(""))).alias("k1"), F.xxhash64(F.lit(1), "file_path", "content").alias("k2")]


def redact(chunks: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(id, start_line, content, changed): every row, its found values masked.

    Contents are read once for candidates; the spans of found values, few against the rows, are joined back by the content's key, by
    salt, and masked by built-in expressions.
    """
    model, found, key = learn(chunks, sample)
    spans = _scored(model, found, key, threshold, "k1 bigint, k2 bigint, spans array<int>").select("k1", "k2", F.posexplode("spans").alias("i", "at"), "spans").where("i % 2 = 0")
    masks = spans.select("k1", "k2", F.struct(F.col("at").alias("a"), F.element_at("spans", F.col("i") + 2).alias("b")).alias("s")).groupBy("k1", "k2").agg(F.collect_set("s").alias("spans"))
    masks = masks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = chunks.select("id", "start_line", "content", *_content_key(), F.pmod(F.xxhash64("id", "start_line"), F.lit(SALTS)).cast("int").alias("salt"))
    cut = lambda text, lo, n: F.substring(text, lo, n)
    covered = lambda text, s: F.concat(cut(text, F.lit(1), s["a"]), F.regexp_replace(cut(text, s["a"] + 1, s["b"] - s["a"]), "[^\r\n]", MASK), cut(text, s["b"] + 1, F.length(text)))
    clean = F.aggregate(F.coalesce("spans", F.array().cast("array<struct<a:int,b:int>>")), F.col("content"), covered)
    joined = rows.join(masks, ["k1", "k2", "salt"], "left").withColumn("clean", clean)
    return joined.select("id", "start_line", F.col("clean").alias("content"), F.coalesce(F.col("clean") != F.col("content"), F.lit(False)).alias("changed"))
