"""Template residue, filler, error pages and notices that scripts are required.

A multi-pattern automaton (Aho-Corasick) reads each text once for everything that may speak for exclusion: phrases of error pages,
script notices and filler in seven languages, words of Latin filler, openings of template fields, and the words that programs print for
lost values. A text without a match is content. In the others, code, quotes and markup are left aside, and matches count by what they
cover: a sentence is residue if matched characters make up ``OF_SENTENCE`` of it (runs of Latin filler: ``LATIN_COVER``). A text is an
error page or notice if such sentences cover at least ``COVER`` of its prose (rows of links, headings and markup aren't prose). One
sentence of filler is enough, since a text that contains filler is to be excluded; so is one field where a value belongs, unless the
words beside it name it as notation. The covered share of the prose is reported for every kind.

Defined results: null, empty and blank texts aren't residue; repeated texts come out for each doc_id.
"""

from __future__ import annotations

import re
from collections import Counter

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

COVER, OF_SENTENCE, LATIN_COVER, LATIN_RUN = 0.5, 0.35, 0.5, 4

# Phrases of error pages, in lower case.
ERROR = """
404 not found|page not found|page can't be found|page cannot be found|page could not be found|page you requested|the requested url|it may have been moved or deleted|you asked for is no longer here|we're sorry, but the|no longer available|
403 forbidden|401 unauthorized|400 bad request|405 method not allowed|410 gone|429 too many requests|access denied|your request was blocked|you don't have permission to access|you do not have permission to access|permission denied|
500 internal server error|500 - internal server error|internal server error|something went wrong while loading|something went wrong|an unexpected error occurred|an error occurred while processing your request|application error|error establishing a connection|error establishing a database connection|
502 bad gateway|bad gateway|503 service unavailable|service unavailable|service temporarily unavailable|is down for maintenance|down for maintenance|temporarily down|504 gateway timeout|gateway timeout|gateway time-out|while contacting upstream|took too long to respond|this site can't be reached|
connection refused|connection timed out|too many requests|please slow down and try again|rate limit exceeded|your session has expired|please sign in again|please log in again|session expired|prove that you are not a robot|prove you are human|verify you are human|checking your browser|
{"error": {"code":|{"error":|"status": "internal"|try again later|please try again|
seite nicht gefunden|zurück zur startseite|interner serverfehler|bitte später erneut versuchen|zugriff verweigert|melden sie sich erneut an|dienst nicht verfügbar|ihre sitzung ist abgelaufen|ein fehler ist aufgetreten|zu viele anfragen|
page introuvable|retour à l'accueil|une erreur interne est survenue|erreur 500|erreur 404|connectez-vous à nouveau|accès refusé à cette ressource|accès refusé|accès interdit|service indisponible|votre session a expiré|une erreur est survenue|trop de requêtes|
página no encontrada|compruebe la dirección|error interno del servidor|acceso denegado|inicie sesión de nuevo|servicio no disponible|su sesión ha caducado|se ha producido un error|demasiadas solicitudes|
页面不存在|已被删除|页面未找到|找不到页面|服务器内部错误|请稍后再试|访问被拒绝|拒绝访问|服务不可用|会话已过期|请重新登录|无权访问|请求过多|网关超时|
ページが見つかりません|ご確認ください|アクセスが拒否されました|サーバーエラー|サーバー内部エラー|エラーが発生しました|サービスを利用できません|しばらくしてから|セッションの有効期限|もう一度ログイン|再度ログイン|
ошибка 404|ошибка 500|страница не найдена|внутренняя ошибка сервера|доступ запрещён|доступ запрещен|войдите снова|сервис недоступен|попробуйте позже|время сеанса истекло|произошла ошибка|слишком много запросов
"""
# Phrases of notices that scripts are required.
SCRIPT = """
you need to enable javascript|please enable javascript|enable javascript to|javascript is required|javascript is disabled|javascript must be enabled|requires javascript|doesn't work without javascript|does not work without javascript|works best with javascript enabled|javascript seems to be disabled|some parts of this|
please turn on scripts in your browser|turn on scripts|turn on javascript|scripts are allowed for this site|if nothing happens, check that|scripting and cookies switched off|both are required to show this page|enable cookies|scripts are blocked|
bitte aktivieren sie javascript|benötigt skripte|bitte im browser einschalten|javascript ist deaktiviert|javascript aktivieren|
veuillez activer javascript|activer javascript|les scripts sont bloqués|la page ne peut pas être affichée|javascript est désactivé|
active javascript para ver este contenido|active javascript para|habilite javascript|activar javascript|bloquea los scripts|permítalos para continuar|javascript está desactivado|
请启用 javascript|启用javascript|需要脚本支持|请在浏览器中开启|请开启 javascript|javascript 已禁用|
javascript を有効にして|javascriptを有効|スクリプトを有効|javascript が無効|
включите javascript|включить javascript|javascript отключён|javascript отключен|нужны скрипты|скрипты отключены|скрипты заблокированы|разрешите скрипты
"""
# Phrases of filler.
FILLER = """
placeholder copy|final wording to follow|sample paragraph|replace this text with your own|replace this text|your text goes here|your text here|text goes here|insert text here|insert your text|add your text here|dummy content|dummy text|for layout only|content coming soon|lorem ipsum dolor|filler text|
hier steht ihr text|hier steht dein text|blindtext|wird noch ersetzt|platzhaltertext|mustertext|beispieltext|
ici votre texte|votre texte ici|texte d'exemple|à remplacer|faux texte|texte de remplissage|
texto de ejemplo|su texto aquí|tu texto aquí|texto de relleno|escriba aquí su texto|
此处填写内容|此处填写|在此输入文字|这里是示例文字|示例文本|占位文字|
ここに文章が入ります|ここに文章|ここにテキスト|ダミーテキスト|サンプルテキスト|
здесь будет текст|здесь ваш текст|текст-заполнитель|пример текста|ваш текст здесь
"""
# Sentences that stand on such pages besides.
TAIL = """
if this keeps happening, contact support|contact support|go back|terms of use|try again later|reload the page|return to the home page|loading
"""
# Words of Latin filler.
LATIN = set(
    """lorem ipsum dolor sit amet consectetur consectetuer adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation
ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui
officia deserunt mollit anim id est laborum""".split()
)

_FIELD = re.compile(
    r"""(?x) \{\{[{]?\s*[A-Za-z_][\w.\-\ |]*\s*\}\}[}]? | <%=?\s*[\w.\ @]+?\s*%> | \[\[\s*[A-Za-z_][\w.\- ]*\s*\]\] | %\([A-Za-z_]\w*\)[sdrif] | \$\{[A-Za-z_][\w.]*\} | \$\[[A-Za-z_][\w.]*\] | @@[A-Z][A-Z0-9_]*@@ | \bXX+_[A-Z0-9_]+_XX+\b
    | %[A-Z][A-Z0-9_]{2,}% | (?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+__(?!\w) | \[object\ Object\] | (?<![\w$\{])\{\d{1,2}\}(?!\}) | \#\{[A-Za-z_][\w.]*\} | \#\#[A-Z][A-Z0-9_]+\#\#
    | \[(?:INSERT|Insert|insert|ENTER|Enter|YOUR|Your|your|ADD|Add)\ [^\]\n]{1,60}\](?!\() | \[[^\]\n]{1,60}\ (?:goes\ here|here)\](?!\() | <(?:your|insert|enter|add|YOUR|INSERT|ENTER|Your|Insert)\ [^<>\n]{1,60}> | \[(?:NAME|DATE|COMPANY|TITLE|EMAIL|ADDRESS|PHONE|PRODUCT)(?:[\ _][A-Z]+)*\](?!\()"""
)
# A value that a program left out, where a value belongs.
_LOST = re.compile(r"(?:(?<![\w-])(?:Dear|Hello|Hi|by|to|from|Ask|Contact|on|for)|^[ \t]*(?:[-*][ \t]+)?[A-Z]\w*(?: \w+)?:)[ \t]+(?:undefined|null|None|NaN|nil|N/A\?)(?=[ \t]*(?:[,.!]|$|[ \t](?:about|for|last)\b))", re.M)
# Openings of fields, and words of lost values, as the automaton sees them (lower case).
OPENS = "{{ <% [[ %( ${ $[ @@ xx_ __ [object # { [insert [enter [your [add here] <your <insert <enter <add [name [date [company [title [email [address [phone [product %".split()
LOST = "undefined null none nan nil n/a?".split()
# Words beside a field that name it as notation: the text speaks of templates.
_NOTATION = r"(?:syntax|placeholders?|notation|variables?|markers?|tags?|directives?|macros?|expressions?|escapes?|literals?|platzhalter|syntaxe|variable|sintaxis|marcador(?:es)?|占位符|语法|構文|プレースホルダー?|синтаксис\w*|переменн\w+)"
_NAMED_AFTER, _NAMED_BEFORE = re.compile(rf"(?i)[\s'\"]*{_NOTATION}(?!\w)"), re.compile(rf"(?i)(?<!\w)(?:{_NOTATION}|written as|such as)[\s:'\"]*$")
_FENCE = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1|\Z)")
_INLINE = re.compile(r"``[^\n]+?``|`[^`\n]*`")
_QUOTE = re.compile(r"\"[^\"\n]{1,240}\"|“[^”\n]{1,240}”|«[^»\n]{1,240}»|「[^」\n]{1,240}」|(?<!\w)'[^'\n]{3,240}'(?!\w)")
_TAGS = re.compile(r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>|<!--.*?-->|<!doctype[^>]*>", re.S | re.I)
_CODE_LINE = re.compile(r"^(?:\t| {4,})\S|[;{]\s*$|^\s*[})\]]+[;,]?\s*$|=>|:=|==|\(\)|&&|\|\||\s=\s|^\s*(?:\$ |> |//|#!|curl |export |import |from \S+ import |const |let |var |def |func |fn |return\b|if \(|for \(|echo |docker |npm |pip |git )")
_SENTENCE = re.compile(r"[^.!?。！？\n]+(?:[.!?。！？]+(?=\s|$|[^\x00-\x7f])|[.!?](?=\S)[^.!?。！？\n]*)*[.!?。！？]*")
_WORD = re.compile(r"[^\W\d_]+")


_PHRASES = [(kind, p.strip()) for kind, block in (("filler", FILLER), ("error", ERROR), ("script", SCRIPT), ("tail", TAIL)) for p in block.replace("\n", "").split("|") if p.strip()]


def _build() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, words in (("latin", [w for w in LATIN if len(w) > 4]), ("lost", LOST), ("field", OPENS)):
        for w in words:
            a.add_word(w, (kind, len(w)))
    for kind, phrase in _PHRASES:
        a.add_word(phrase, (kind, len(phrase)))
    a.make_automaton()
    return a


_AUTOMATON: list = []


def automaton() -> ahocorasick.Automaton:
    if not _AUTOMATON:
        _AUTOMATON.append(_build())
    return _AUTOMATON[0]


def _blank(pattern: re.Pattern, text: str) -> str:
    """``text`` with what matches replaced by as many spaces, lines kept."""
    return pattern.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)


def _prose(text: str) -> str:
    """``text`` with code blocks, inline code and lines of code blanked."""
    if "`" in text or "~~~" in text:
        text = _blank(_INLINE, _blank(_FENCE, text))
    return "\n".join(" " * len(line) if _CODE_LINE.search(line) and '{"error"' not in line else line for line in text.split("\n"))


def fields(prose: str) -> list[tuple[int, int]]:
    """Spans of fields left unfilled, and of lost values where one belongs, but for those that are named as notation."""
    plain = _blank(_QUOTE, prose) if '"' in prose or "'" in prose or "“" in prose else prose
    found = [m.span() for m in _FIELD.finditer(plain)]
    found = [(a, b) for a, b in found if not _NAMED_AFTER.match(prose, b) and not _NAMED_BEFORE.search(prose, max(0, a - 40), a)]
    return found + [m.span() for m in _LOST.finditer(prose)]


def _latin(sentence: str) -> int:
    """Characters in runs of at least ``LATIN_RUN`` words of Latin filler."""
    covered, run = 0, []
    for m in [*_WORD.finditer(sentence.lower()), None]:
        if m and m.group() in LATIN:
            run.append(m.span())
            continue
        if len(run) >= LATIN_RUN:
            covered += run[-1][1] - run[0][0]
        run = []
    return covered


def classify(text: str | None) -> str | None:
    """``field``, ``filler``, ``error`` or ``script``, or None for content."""
    found = judge(text)
    return found[0] if found else None


def judge(text: str | None) -> tuple[str, float] | None:
    """The kind of residue, and the share of the prose that it covers; None for content."""
    if not text or not text.strip():
        return None
    kinds = Counter(kind for _, (kind, _) in automaton().iter(text.lower().replace("’", "'")))
    if not kinds.keys() & {"field", "lost", "filler", "error", "script"} and kinds["latin"] < 2:
        return None
    prose = _prose(text)
    if kinds["field"] or kinds["lost"]:
        spans = fields(prose)
        if spans:
            return "field", sum(b - a for a, b in spans) / max(1, len("".join(prose.split())))
    if not kinds.keys() & {"filler", "error", "script"} and kinds["latin"] < 2:
        return None
    low = prose.lower().replace("’", "'")
    hits = [(end - n + 1, end + 1, kind) for end, (kind, n) in automaton().iter(low)] if len(low) == len(prose) else [(m.start(), m.end(), k) for k, m in _slow(low)]
    hits = [h for h in hits if h[2] in ("filler", "error", "script", "tail")]
    shown = _TAGS.sub(lambda m: "\n" * len(m.group()), prose) if "<" in prose else prose  # a tag ends a sentence
    quotes = [m.span() for m in _QUOTE.finditer(shown)]
    inside = lambda a, b: any(x <= a and b <= y for x, y in quotes)
    hits = sorted(h for h in hits if not inside(h[0], h[1]))
    matched, rest, kinds, filler = 0, 0, {}, False
    at = 0
    for line in shown.split("\n"):
        start, at = at, at + len(line) + 1
        words = line.split()
        links = " | " in line
        for s in _SENTENCE.finditer(line):
            a, b = start + s.start(), start + s.end()
            said = s.group().strip()
            size = len(said)
            if not size:
                continue
            # Overlapping matches count once.
            own, last, by = 0, a, {}
            for x, y, kind in hits:
                if x >= b:
                    break
                if y > a:
                    n = min(y, b) - max(x, last, a)
                    if n > 0:
                        own, last = own + n, min(y, b)
                        by[kind] = by.get(kind, 0) + n
            if _latin(said) >= LATIN_COVER * size:
                filler = True
                matched += size
            elif own >= OF_SENTENCE * size:
                matched += size
                if by.get("filler", 0) >= OF_SENTENCE * size:
                    filler = True
                for kind, n in by.items():
                    kinds[kind] = kinds.get(kind, 0) + n
            elif not links and (len(words) > 3 or said[-1] in ".!?。！？" and len(words) > 2 or len(said) > 40):
                rest += size
    covered = matched / max(1, matched + rest)
    if filler:
        return "filler", covered
    if matched >= COVER * (matched + rest) and (kinds.get("error") or kinds.get("script")):
        return ("error" if kinds.get("error", 0) >= kinds.get("script", 0) else "script"), covered
    return None


def _slow(low: str):
    """Matches by plain search, where lower-casing moved positions."""
    for kind, phrase in _PHRASES:
        for m in re.finditer(re.escape(phrase), low):
            yield kind, m


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, kind, coverage) of every text that is to be excluded; one pass, no shuffle."""

    def run(batches):
        for batch in batches:
            found = [(i, *k) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if (k := judge(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], kind) for c, kind in enumerate((pa.int64(), pa.string(), pa.float64()))], ["doc_id", "kind", "coverage"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, kind string, coverage double")
