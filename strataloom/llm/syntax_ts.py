"""TypeScript, with or without JSX: tokens and grammar."""

from __future__ import annotations

import re
from collections.abc import Iterator

from strataloom.llm.pushdown import AHEAD, Grammar

# Words with a meaning of their own; the second group may also be names.
RESERVED = "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
CONTEXTUAL = "abstract accessor as asserts assert async await declare from get global implements infer interface is keyof let module namespace of out override private protected public readonly require satisfies set static type unique using yield".split()

_WORDS = {w: w for w in RESERVED + CONTEXTUAL}
_ENDS = {"ID", "NUM", "STR", "REGEX", "TPL", "TPLTAIL", "PRIVATE", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--", "JSXEND", *CONTEXTUAL} - {"await", "yield", "of", "as", "is", "keyof", "satisfies"}

_TOKEN = re.compile(
    r"""(?P<nl>[ \t\f\v\ufeff\xa0]*(?:\r\n|\n|\r|[\u2028\u2029])\s*)|(?P<ws>[ \t\f\v\ufeff\xa0]+)|(?P<lc>//[^\n\r]*)|(?P<bc>/\*.*?\*/)
    |(?P<id>(?:[A-Za-z_$]|[^\x00-\x7f]|\\u[0-9a-fA-F]{4})(?:[\w$]|\\u[0-9a-fA-F]{4})*)
    |(?P<num>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)n?(?![A-Za-z_$\d]))
    |(?P<str>'(?:[^'\\\n\r]|\\(?:\r\n|.))*'|"(?:[^"\\\n\r]|\\(?:\r\n|.))*")
    |(?P<tpl>`(?:[^`\\$]|\\.|\$(?!\{))*(?:`|\$\{))|(?P<private>\#[A-Za-z_$][\w$]*)|(?P<shebang>\A\#![^\n]*)
    |(?P<op>\.\.\.|=>|===|!==|==|!=|<=|\?\?=|\?\?|\?\.(?!\d)|&&=|\|\|=|&&|\|\||\*\*=|\*\*|\+\+|--|\+=|-=|\*=|%=|&=|\|=|\^=|<<=|<<|[{}()\[\];,<>+\-*%&|^!~?:=.@]|/=|/)""",
    re.S | re.X,
)
_REST = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(?:`|\$\{)", re.S)
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_TAG = re.compile(r"<\s*(?:(?P<close>/)\s*)?(?P<name>[A-Za-z_$][\w$.:\-]*)?")
_ATTR = re.compile(r"\s*(?:/\*.*?\*/\s*)*(?:(?P<name>[A-Za-z_$][\w$:\-]*)(?:\s*=\s*(?:(?P<str>\"[^\"]*\"|'[^']*')|(?P<open>\{)))?|(?P<spread>\{)|(?P<self>/\s*>)|(?P<end>>))", re.S)
_TEXT = re.compile(r"[^<{}>]*")
_GENERIC = re.compile(r"<\s*(?:const\s+)?[A-Za-z_$][\w$]*\s*(?:,|extends\b)")


def tokens(text: str, jsx: bool = False) -> Iterator[str]:
    """Token classes of a text; "?" where nothing matches. Template and JSX braces are told from blocks by a stack."""
    out: list[str] = []
    stack: list = []  # "{": a block's brace; "`": a template's; a list: of a JSX element, its open names
    heads: list[bool] = []  # of open parentheses: whether a statement's head, after which an expression begins
    at, n, prev = 0, len(text), ""
    while at < n:
        if len(out) > AHEAD:  # the last one is looked back at
            yield from out[:-1]
            del out[:-1]
        m = _TOKEN.match(text, at)
        c = text[at]
        if c == "/" and (m is None or m.lastgroup == "op") and prev not in _ENDS:
            m2 = _REGEX.match(text, at)
            if m2:
                out.append("REGEX")
                prev, at = "REGEX", m2.end()
                continue
        if m is None:
            yield from [*out, "?"]
            return
        kind, at2 = m.lastgroup, m.end()
        if kind == "ws" or kind == "lc" or kind == "shebang":
            at = at2
            continue
        if kind == "bc" or kind == "nl":
            if (kind == "nl" or "\n" in m.group()) and (not out or out[-1] != "\n"):
                out.append("\n")
            at = at2
            continue
        if kind == "id":
            t = _WORDS.get(m.group(), "ID")
        elif kind == "num":
            t = "NUM"
        elif kind == "str":
            t = "STR"
        elif kind == "private":
            t = "PRIVATE"
        elif kind == "tpl":
            if text[at2 - 1] == "`":
                t = "TPL"
            else:
                t = "TPLHEAD"
                stack.append("`")
        else:
            t = m.group()
            if t == "{":
                stack.append("{")
            elif t == "}":
                if not stack:
                    yield from [*out, "?"]
                    return
                top = stack.pop()
                if top == "`":
                    m = _REST.match(text, at2)
                    if m is None:
                        yield from [*out, "?"]
                        return
                    at2 = m.end()
                    t = "TPLTAIL" if text[at2 - 1] == "`" else "TPLMID"
                    if t == "TPLMID":
                        stack.append("`")
                elif isinstance(top, tuple):
                    out.append("}")
                    at2 = _element(text, at2, top[0], out, stack, top[1])
                    if at2 < 0:
                        yield from [*out, "?"]
                        return
                    prev, at = out[-1], at2
                    continue
            elif t == "<" and jsx and prev not in _ENDS and not _GENERIC.match(text, at):
                tag = _TAG.match(text, at)
                if not tag.group("close"):
                    out.append("JSX")
                    at2 = _element(text, at, [], out, stack, "tag")
                    if at2 < 0:
                        yield from [*out, "?"]
                        return
                    prev, at = out[-1], at2
                    continue
        out.append(t)
        if t == "(":
            heads.append(prev in ("if", "while", "for", "with"))
        prev, at = "" if t == ")" and heads and heads.pop() else t, at2
    yield from out if not stack else [*out, "?"]


def _element(text: str, at: int, names: list, out: list, stack: list, where: str) -> int:
    """Reads JSX from ``at`` up to its end or the next expression in braces; -1 if it isn't well formed."""
    while True:
        if where == "tag":
            tag = _TAG.match(text, at)
            if tag is None:
                return -1
            at, name = tag.end(), tag.group("name") or ""
            if tag.group("close"):
                end = re.compile(r"\s*>").match(text, at)
                if not names or names.pop() != name or end is None:
                    return -1
                at = end.end()
                if not names:
                    out.append("JSXEND")
                    return at
                where = "children"
            else:
                names.append(name)
                where = "attributes"
        elif where == "attributes":
            a = _ATTR.match(text, at)
            if a is None:
                return -1
            at = a.end()
            if a.group("open") or a.group("spread"):
                out.append("{")
                stack.append((names, "attributes"))
                return at
            if a.group("self"):
                names.pop()
                if not names:
                    out.append("JSXEND")
                    return at
                where = "children"
            elif a.group("end"):
                where = "children"
        else:
            at = _TEXT.match(text, at).end()
            if at >= len(text) or text[at] in "}>":
                return -1
            if text[at] == "{":
                out.append("{")
                stack.append((names, "children"))
                return at + 1
            where = "tag"


_CONTEXT = " | ".join(f"'{w}'" for w in CONTEXTUAL)
_ALL = " | ".join(f"'{w}'" for w in RESERVED)

GRAMMAR = f"""
module: {{ item }}
unit: one_decl [';'] | exprs [';']
one_decl: {{ decorator }} ['abstract'] class_decl | fn_decl | interface | enum
member_unit: member
id: ID | {_CONTEXT}
word: id | {_ALL}
semi: ';' | SOFT
item: import | export | stmt
import: 'import' ( STR [ attrs ] semi | ['type'] import_clause 'from' STR [ attrs ] semi | ['type'] id '=' ( 'require' '(' STR ')' | id {{ '.' word }} ) semi )
import_clause: id [ ',' ( named | star ) ] | named | star
star: '*' 'as' id
named: '{{' [ spec {{ ',' spec }} [','] ] '}}'
spec: ['type'] name_or_str [ 'as' name_or_str ]
name_or_str: word | STR
attrs: ( 'with' | 'assert' ) object
export: {{ decorator }} 'export' ( '*' [ 'as' name_or_str ] 'from' STR [ attrs ] semi | ['type'] named [ 'from' STR [ attrs ] ] semi | 'default' ( {{ decorator }} ['abstract'] class_decl | fn_decl | fn_expr | interface | assign_ns semi | object semi ) | declared | '=' exprs semi | 'as' 'namespace' id semi | import )
declared: variables semi | fn_decl | {{ decorator }} ['abstract'] class_decl | interface | alias | enum | namespace | 'declare' declared
block: '{{' {{ stmt }} '}}'
stmt: block | ';' | declared | 'if' '(' exprs ')' stmt [ 'else' stmt ] | loop | 'continue' [ id ] semi | 'break' [ id ] semi | 'return' [ exprs ] semi | 'throw' exprs semi | id ':' stmt | switch | try | 'debugger' semi | exprs_ns semi
loop: 'while' '(' exprs ')' stmt | 'do' stmt 'while' '(' exprs ')' [ semi ] | 'for' ['await'] '(' ( [ variables | exprs ] ';' [ exprs ] ';' [ exprs ] | [ 'var' | 'let' | 'const' | 'using' ] ( pattern | operand ) ( 'of' | 'in' ) exprs ) ')' stmt
switch: 'switch' '(' exprs ')' '{{' {{ ( 'case' exprs | 'default' ) ':' {{ stmt }} }} '}}'
try: 'try' block ( 'catch' [ '(' pattern [ ':' type ] ')' ] block [ 'finally' block ] | 'finally' block )
variables: ( 'var' | 'let' | 'const' | 'using' ) bound {{ ',' bound }}
bound: pattern ['!'] [ ':' type ] [ '=' assign ]
pattern: id | '[' [ pelem ] {{ ',' [ pelem ] }} ']' | '{{' [ pprop {{ ',' pprop }} [','] ] '}}'
pelem: ['...'] pattern [ '=' assign ]
pprop: '...' pattern | key ':' pattern [ '=' assign ] | id [ '=' assign ]
exprs: assign {{ ',' assign }}
exprs_ns: assign_ns {{ ',' assign }}
assign: simple | object more | fn_expr more | class_decl more | arrow | yield
assign_ns: simple | arrow | yield
body: simple | fn_expr more | class_decl more | arrow | yield
yield: 'yield' ['*'] [ assign ]
simple: ( plain | unary operand ) more
more: {{ suffix }} {{ infix operand }} [ '?' assign ':' assign ] [ ( '=' | '+=' | '-=' | '*=' | '%=' | '/=' | '&=' | '|=' | '^=' | '<<=' | '**=' | '??=' | '&&=' | '||=' | '>' '>' '=' | '>' '>' '>' '=' ) assign ]
infix: '+' | '-' | '*' | '/' | '%' | '**' | '<<' | '>' | '>' '=' | '>' '>' | '>' '>' '>' | '&' | '|' | '^' | '&&' | '||' | '??' | '==' | '!=' | '===' | '!==' | '<' | '<=' | 'instanceof' | 'in'
unary: '+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' | 'new' | CAST '<' type '>'
operand: {{ unary }} ( plain | object | fn_expr | class_decl | arrow ) {{ suffix }}
plain: id | 'this' | 'super' | NUM | STR | REGEX | 'null' | 'true' | 'false' | template | jsx | PRIVATE | '(' exprs ')' | '[' [ aelem ] {{ ',' [ aelem ] }} ']' | 'import' '(' assign [ ',' assign ] [','] ')' | 'import' '.' word | 'new' '.' word
template: TPL | TPLHEAD exprs {{ TPLMID exprs }} TPLTAIL
jsx: JSX {{ '{{' [ ['...'] exprs ] '}}' | jsx }} JSXEND
suffix: '.' ( word | PRIVATE ) | '?.' ( word | PRIVATE | '[' exprs ']' | [ type_args ] args ) | '[' exprs ']' | args | template | '++' | '--' | '!' | 'as' type | 'as' 'const' | 'satisfies' type | type_args ( args | template )
aelem: ['...'] assign
args: '(' [ aelem {{ ',' aelem }} [','] ] ')'
object: '{{' [ prop {{ ',' prop }} [','] ] '}}'
prop: '...' assign | key ':' assign | id [ '=' assign ] | {{ 'async' | 'get' | 'set' | '*' }} key fn_tail
key: word | STR | NUM | PRIVATE | '[' assign ']'
fn_tail: [ type_params ] '(' params ')' [ ':' ret ] block
fn_expr: ['async'] 'function' ['*'] [ id ] fn_tail
fn_decl: ['async'] 'function' ['*'] id [ type_params ] '(' params ')' [ ':' ret ] ( block | semi )
arrow: ['async'] ( id | [ type_params ] '(' params ')' [ ':' ret ] ) '=>' ( block | body )
params: [ param {{ ',' param }} [','] ]
param: {{ decorator }} {{ 'public' | 'private' | 'protected' | 'readonly' | 'override' }} ( ['...'] pattern ['?'] [ ':' type ] [ '=' assign ] | 'this' [ ':' type ] )
decorator: '@' ( id {{ '.' word }} [ args ] | '(' exprs ')' )
class_decl: 'class' [ id ] [ type_params ] [ 'extends' ( plain | class_decl | fn_expr ) {{ suffix }} [ type_args ] ] [ 'implements' type {{ ',' type }} ] '{{' {{ member }} '}}'
member: ';' | 'static' block | {{ decorator }} {{ 'public' | 'private' | 'protected' | 'static' | 'abstract' | 'override' | 'readonly' | 'declare' | 'async' | 'accessor' | 'get' | 'set' | '*' }} ( key [ '?' | '!' ] ( [ type_params ] '(' params ')' [ ':' ret ] ( block | semi ) | [ ':' type ] [ '=' assign ] semi ) | '[' id ':' type ']' ':' type semi )
interface: 'interface' id [ type_params ] [ 'extends' type {{ ',' type }} ] shape
alias: 'type' id [ type_params ] '=' type semi
enum: ['const'] 'enum' id '{{' [ key [ '=' assign ] {{ ',' key [ '=' assign ] }} [','] ] '}}'
namespace: ( 'namespace' | 'module' ) ( id {{ '.' word }} | STR ) ( '{{' {{ item }} '}}' | semi ) | 'global' '{{' {{ item }} '}}'
type: [ '|' | '&' ] tchain {{ ( '|' | '&' ) tchain }} [ 'extends' type '?' type ':' type ]
tchain: {{ 'keyof' | 'readonly' | 'unique' | 'infer' }} tprim {{ '[' [ type ] ']' }}
tprim: id {{ '.' word }} [ type_args ] | 'typeof' ( id | 'this' ) {{ '.' word }} [ type_args ] | 'typeof' timport | 'void' | 'null' | 'this' | 'true' | 'false' | STR | ['-'] NUM | ttemplate | '(' type ')' | shape | '[' [ telem {{ ',' telem }} [','] ] ']' | timport | ['abstract'] ['new'] [ type_params ] '(' params ')' '=>' ret
timport: 'import' '(' type ')' {{ '.' word }} [ type_args ]
ttemplate: TPL | TPLHEAD type {{ TPLMID type }} TPLTAIL
ret: type | 'asserts' ( id | 'this' ) [ 'is' type ] | ( id | 'this' ) 'is' type
telem: ['...'] [ word ['?'] ':' ] type ['?']
shape: '{{' [ tmember {{ tsep tmember }} [ tsep ] ] '}}'
tsep: ';' | ',' | SOFT
tmember: {{ 'readonly' | 'get' | 'set' }} key ['?'] ( [ ':' type ] | [ type_params ] '(' params ')' [ ':' ret ] ) | ['new'] [ type_params ] '(' params ')' [ ':' ret ] | [ '+' | '-' ] ['readonly'] '[' id ( ':' | 'in' ) type [ 'as' type ] ']' [ '+' | '-' ] ['?'] [ ':' type ]
type_args: '<' type {{ ',' type }} '>'
type_params: '<' tparam {{ ',' tparam }} [','] '>'
tparam: {{ 'const' | 'in' | 'out' }} id [ 'extends' type ] [ '=' type ]
"""

_STARTS = ("module", "unit", "member_unit")
PLAIN = Grammar(GRAMMAR.replace("CAST '<'", "'<'"), _STARTS, soft_end="SOFT")
WITH_JSX = Grammar(GRAMMAR, _STARTS, soft_end="SOFT")
START = {"file": "module", "class": "unit", "function": "unit", "method": "member_unit"}


def valid(text: str, chunk_type: str, jsx: bool) -> bool:
    """Whether the text is a module, one declaration or function expression, or one class member."""
    return (WITH_JSX if jsx else PLAIN).accepts(tokens(text, jsx), START.get(chunk_type, "module"))
