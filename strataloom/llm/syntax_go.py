"""Go: tokens, with the semicolons that line ends stand for, and grammar."""

from __future__ import annotations

import re
from collections.abc import Iterator

from strataloom.llm.pushdown import AHEAD, Grammar

# The language's keywords.
KEYWORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
_WORDS = {w: w for w in KEYWORDS}
_CLOSES = {"ID", "LIT", "STR", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
_TOKEN = re.compile(
    r"""(?P<ws>[ \t\r\ufeff]+|/\*[^\n]*?\*/)|(?P<nl>\n|//[^\n]*|/\*.*?\*/)|(?P<id>[A-Za-z_\u00aa-\uffff][\w\u00aa-\uffff]*)
    |(?P<lit>(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)i?(?![A-Za-z_\d])|'(?:[^'\\\n]|\\(?:[abfnrtv\\'"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')
    |(?P<str>"(?:[^"\\\n]|\\.)*"|`[^`]*`)
    |(?P<op>\.\.\.|<<=|>>=|&\^=|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^<>=!()\[\]{},;.:~])""",
    re.S | re.X,
)
_ASSIGN = "'=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='"

GRAMMAR = f"""
file: 'package' ID ';' {{ 'import' ( ispec | '(' [ ispec {{ ';' ispec }} [';'] ] ')' ) ';' }} {{ top ';' }}
unit: top [';'] | func_lit [';']
ispec: [ '.' | ID ] STR
top: dec | 'func' [ '(' params ')' ] ID [ tparams ] sig [ block ]
dec: 'const' ( cspec | '(' [ cspec {{ ';' cspec }} [';'] ] ')' ) | 'var' ( vspec | '(' [ vspec {{ ';' vspec }} [';'] ] ')' ) | 'type' ( tspec | '(' [ tspec {{ ';' tspec }} [';'] ] ')' )
ids: ID {{ ',' ID }}
cspec: ids [ [ type ] '=' exprs ]
vspec: ids ( type [ '=' exprs ] | '=' exprs )
tspec: ID [ tparams ] ['='] type
tparams: '[' ids constraint {{ ',' ids constraint }} [','] ']'
constraint: cterm {{ '|' cterm }}
cterm: ['~'] type
sig: '(' params ')' [ type | '(' params ')' ]
params: [ pd {{ ',' pd }} [','] ]
pd: type | ID type | [ ID ] '...' type
type: ID [ '.' ID ] [ '[' type {{ ',' type }} [','] ']' ] | ptype
ptype: '*' type | '(' type ')' | ctype
ctype: '[' ']' type | '[' ( expr | '...' ) ']' type | 'map' '[' type ']' type | 'chan' ['<-'] type | '<-' 'chan' type | 'func' sig | 'struct' '{{' [ field {{ ';' field }} [';'] ] '}}' | 'interface' '{{' [ elem {{ ';' elem }} [';'] ] '}}'
field: ids type [ STR ] | ['*'] ID [ '.' ID ] [ '[' type {{ ',' type }} ']' ] [ STR ]
elem: ID sig | constraint
block: '{{' stmts '}}'
stmts: [ stmt ] {{ ';' [ stmt ] }}
stmt: dec | simple | 'go' expr | 'defer' expr | 'return' [ exprs ] | 'break' [ ID ] | 'continue' [ ID ] | 'goto' ID | 'fallthrough' | block | if | switch | select | for | ID ':' [ stmt ]
simple: exprs [ ( {_ASSIGN} | ':=' ) exprs | '++' | '--' | '<-' expr ]
if: 'if' [ [ simple ] ';' ] expr block [ 'else' ( if | block ) ]
switch: 'switch' [ [ simple ] ';' ] [ simple ] '{{' {{ ( 'case' arg {{ ',' arg }} | 'default' ) ':' stmts }} '}}'
select: 'select' '{{' {{ ( 'case' simple | 'default' ) ':' stmts }} '}}'
for: 'for' [ simple | [ simple ] ';' [ expr ] ';' [ simple ] | [ exprs ( '=' | ':=' ) ] 'range' expr ] block
exprs: expr {{ ',' expr }}
expr: operand {{ binary operand }}
binary: '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>>' | '&^' | '&&' | '||' | '==' | '!=' | '<' | '<=' | '>' | '>='
operand: {{ '+' | '-' | '!' | '^' | '*' | '&' | '<-' }} primary {{ suffix }}
primary: ID | LIT | STR | '(' ( expr | ptype ) ')' | func_lit | ctype ( literal | '(' expr [','] ')' )
func_lit: 'func' sig block
suffix: '.' ID | '.' '(' ( type | 'type' ) ')' | '[' arg {{ ',' arg }} [','] ']' | '[' [ expr ] ':' [ expr ] [ ':' expr ] ']' | '(' [ arg {{ ',' arg }} ['...'] [','] ] ')' | literal
arg: expr | ptype
literal: '{{' [ part {{ ',' part }} [','] ] '}}'
part: [ value ':' ] value
value: expr | literal
"""

_GRAMMAR = Grammar(GRAMMAR, ("file", "unit"))


def tokens(text: str) -> Iterator[str]:
    out: list[str] = []
    at, n = 0, len(text)
    while at < n:
        if len(out) > AHEAD:  # the last one is looked back at
            yield from out[:-1]
            del out[:-1]
        m = _TOKEN.match(text, at)
        if m is None:
            yield from [*out, "?"]
            return
        kind = m.lastgroup
        if kind == "id":
            out.append(_WORDS.get(m.group(), "ID"))
        elif kind == "lit":
            out.append("LIT")
        elif kind == "str":
            out.append("STR")
        elif kind == "op":
            out.append(m.group())
        elif kind == "nl" and out and out[-1] in _CLOSES and (m.group()[0] != "/" or "\n" in m.group()):
            out.append(";")
        at = m.end()
    if out and out[-1] in _CLOSES:
        out.append(";")
    yield from out


def valid(text: str, chunk_type: str) -> bool:
    """Whether the text is a source file, or one declaration or function literal."""
    return _GRAMMAR.accepts(tokens(text), "file" if chunk_type == "file" else "unit")
