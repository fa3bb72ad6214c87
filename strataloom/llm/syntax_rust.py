"""Rust, edition 2021: tokens and grammar. Operators of several signs that may belong to generics or closures are read sign by sign."""

from __future__ import annotations

import re
from collections.abc import Iterator

from strataloom.llm.pushdown import AHEAD, Grammar

# Strict keywords.
KEYWORDS = "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split()
_WORDS = {w: w for w in KEYWORDS} | {"_": "_"}
_TOKEN = re.compile(
    r"""(?P<ws>\s+|//[^\n]*|\ufeff)|(?P<bc>/\*)|(?P<shebang>\A\#!(?!\s*\[)[^\n]*)
    |(?P<str>(?:b|c)?"(?:[^"\\]|\\.)*"|(?:br|cr|r)(?P<hash>\#*)".*?"(?P=hash)(?!\#))
    |(?P<char>b?'(?:[^'\\\n\r\t]|\\(?:[nrt\\0'"]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))')|(?P<life>'[A-Za-z_]\w*(?!'))
    |(?P<id>r\#[A-Za-z_]\w*|[A-Za-z_\u00aa-\uffff][\w\u00aa-\uffff]*)
    |(?P<num>0x[0-9a-fA-F_]+\w*|0b[01_]+\w*|0o[0-7_]+\w*|\d[\d_]*(?:\.(?![.A-Za-z_])[\d_]*)?(?:[eE][+-]?[\d_]+)?(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?![A-Za-z_]))
    |(?P<op>\.\.\.|\.\.=|\.\.|::|->|=>|==|!=|<=|\+=|-=|\*=|/=|%=|\^=|&=|\|=|[-+*/%^!&|=<>@.,;:\#$?(){}\[\]~])""",
    re.S | re.X,
)
_COMMENT = re.compile(r"/\*|\*/")

GRAMMAR = """
file: { inner } { item }
unit: { attr } [ vis ] item0 | expr [';']
inner: '#' '!' '[' tts ']'
attr: '#' '[' tts ']'
tts: { tt }
tt: '(' tts ')' | '[' tts ']' | '{' tts '}' | ANY
item: { attr } [ vis ] item0
vis: 'pub' [ '(' ( 'crate' | 'super' | 'self' | 'in' path ) ')' ]
item0: fn | struct | enum | trait | impl | mod | 'use' utree ';' | 'const' ( ID | '_' ) ':' type [ '=' expr ] ';' | 'static' ['mut'] ID ':' type [ '=' expr ] ';' | 'type' ID [ generics ] [ ':' bounds ] [ where ] [ '=' type ] [ where ] ';' | 'extern' 'crate' ( ID | 'self' ) [ 'as' ( ID | '_' ) ] ';' | ['unsafe'] 'extern' [ STR ] '{' { inner } { item } '}' | macro_item
macro_item: path '!' [ ID ] ( '{' tts '}' | '(' tts ')' ';' | '[' tts ']' ';' )
fn: { 'const' | 'async' | 'unsafe' | 'extern' [ STR ] } 'fn' ID [ generics ] '(' [ param { ',' param } [','] ] ')' [ '->' type ] [ where ] ( block | ';' )
param: { attr } ( [ '&' [ LIFE ] ] ['mut'] 'self' [ ':' type ] | pat1 ':' type | '...' )
generics: '<' [ gp { ',' gp } [','] ] '>'
gp: { attr } ( LIFE [ ':' [ bounds ] ] | ID [ ':' [ bounds ] ] [ '=' type ] | 'const' ID ':' type [ '=' ( block | ['-'] lit | ID ) ] )
bounds: bound { '+' bound } ['+']
bound: LIFE | ['?'] [ 'for' generics ] path | '(' bound ')'
where: 'where' [ wp { ',' wp } [','] ]
wp: LIFE ':' [ bounds ] | [ 'for' generics ] type ':' [ bounds ]
type: '(' [ type { ',' type } [','] ] ')' | '!' | '&' [ LIFE ] ['mut'] type | '*' ( 'const' | 'mut' ) type | '[' type [ ';' expr ] ']' | '_' | 'dyn' bounds | 'impl' bounds | [ 'for' generics ] { 'unsafe' | 'extern' [ STR ] } 'fn' '(' [ [ ( ID | '_' ) ':' ] type { ',' [ ( ID | '_' ) ':' ] type } [','] ] ')' [ '->' type ] | path [ '!' delim ]
delim: '(' tts ')' | '[' tts ']' | '{' tts '}'
path: [ '::' ] seg { '::' seg } | '<' type [ 'as' path ] '>' '::' seg { '::' seg }
seg: ( ID | 'self' | 'Self' | 'super' | 'crate' ) [ [ '::' ] gargs | '(' [ type { ',' type } [','] ] ')' [ '->' type ] ]
gargs: '<' [ garg { ',' garg } [','] ] '>'
garg: LIFE | type | ID [ gargs ] ( '=' type | ':' bounds ) | ['-'] lit | block
struct: 'struct' ID [ generics ] ( [ where ] '{' fields '}' | '(' tfields ')' [ where ] ';' | [ where ] ';' )
fields: [ field { ',' field } [','] ]
field: { attr } [ vis ] ID ':' type
tfields: [ { attr } [ vis ] type { ',' { attr } [ vis ] type } [','] ]
enum: 'enum' ID [ generics ] [ where ] '{' [ variant { ',' variant } [','] ] '}'
variant: { attr } ID [ '{' fields '}' | '(' tfields ')' ] [ '=' expr ]
trait: ['unsafe'] 'trait' ID [ generics ] [ ':' [ bounds ] ] [ where ] '{' { inner } { item } '}'
impl: ['unsafe'] 'impl' [ generics ] ['!'] type [ 'for' type ] [ where ] '{' { inner } { item } '}'
mod: 'mod' ID ( ';' | '{' { inner } { item } '}' )
utree: [ '::' ] useg { '::' useg } [ 'as' ( ID | '_' ) | '::' ( '*' | '{' [ utree { ',' utree } [','] ] '}' ) ] | [ '::' ] ( '*' | '{' [ utree { ',' utree } [','] ] '}' )
useg: ID | 'self' | 'super' | 'crate'
block: '{' { inner } { stmt } [ expr ] '}'
stmt: ';' | item | { attr } 'let' pattern [ ':' type ] [ '=' expr [ 'else' block ] ] ';' | expr ';' | { attr } blocklike
blocklike: [ LIFE ':' ] ( loop | block ) | 'unsafe' block | if | match
loop: 'loop' block | 'while' expr block | 'for' pattern 'in' expr block
expr: chain [ range [ chain ] ] | range [ chain ]
range: '..' | '..='
chain: operand { infix operand }
infix: '+' | '-' | '*' | '/' | '%' | '^' | '&' | '|' | '&' '&' | '|' '|' | '<' | '>' | '<' '<' | '>' '>' | '==' | '!=' | '<=' | '>' '=' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '^=' | '&=' | '|=' | '<' '<=' | '>' '>' '='
operand: { attr } { '-' | '!' | '*' | '&' ['mut'] | '&' ID ( 'const' | 'mut' ) } ( primary { suffix } | closure | jump ) | 'let' pattern '=' chain
suffix: '.' ( ID [ '::' gargs ] | 'await' | NUM ) | '(' [ expr { ',' expr } [','] ] ')' | '[' expr ']' | '?' | 'as' type
lit: NUM | STR | CHAR | 'true' | 'false'
primary: lit | epath [ '{' [ init { ',' init } [','] ] [ '..' [ expr ] ] '}' | '{' init { ',' init } ',' '..' [ expr ] '}' | '!' delim ] | '(' [ expr { ',' expr } [','] ] ')' | '[' [ expr ( ';' expr | { ',' expr } [','] ) ] ']' | blocklike | 'async' ['move'] block | 'const' block
epath: [ '::' ] eseg { '::' ( eseg | gargs ) } | '<' type [ 'as' path ] '>' '::' eseg { '::' ( eseg | gargs ) }
eseg: ID | 'self' | 'Self' | 'super' | 'crate'
init: { attr } ( ID | NUM ) [ ':' expr ]
closure: { 'async' | 'static' | 'move' } '|' [ cparam { ',' cparam } [','] ] '|' ( '->' type block | expr )
cparam: { attr } pat1 [ ':' type ]
jump: 'return' [ expr ] | 'break' [ LIFE ] [ expr ] | 'continue' [ LIFE ]
if: 'if' expr block [ 'else' ( if | block ) ]
match: 'match' expr '{' { inner } { arm ( expr ',' | blocklike [','] ) } [ arm expr ] '}'
arm: { attr } pattern [ 'if' expr ] '=>'
pattern: [ '|' ] pat1 { '|' pat1 }
plit: ['-'] NUM | STR | CHAR | 'true' | 'false' | epath
pat1: plit | [ plit ] ( '..=' | '..' | '...' ) [ plit ] | '_' | ['ref'] ['mut'] ID [ '@' pat1 ] | '&' ['mut'] pat1 | '(' [ pattern { ',' pattern } [','] ] ')' | '[' [ pattern { ',' pattern } [','] ] ']' | epath ( '(' [ pattern { ',' pattern } [','] ] ')' | '{' [ fpat { ',' fpat } [','] ] '}' | '!' delim )
fpat: { attr } ( ( ID | NUM ) ':' pattern | ['ref'] ['mut'] ID | '..' )
"""
_SIGNS = "... ..= .. :: -> => == != <= += -= *= /= %= ^= &= |= - + * / % ^ ! & | = < > @ . , ; : # $ ? ~".split()
_ANY = " | ".join(["ID", "NUM", "STR", "CHAR", "LIFE", "'_'"] + [f"'{w}'" for w in KEYWORDS + _SIGNS])
_GRAMMAR = Grammar(GRAMMAR.replace("ANY", _ANY), ("file", "unit"))


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
        kind, at = m.lastgroup, m.end()
        if kind == "hash":
            kind = "str"
        if kind == "ws" or kind == "shebang":
            continue
        if kind == "bc":  # comments nest
            depth = 1
            while depth:
                c = _COMMENT.search(text, at)
                if c is None:
                    yield from [*out, "?"]
                    return
                depth += 1 if c.group() == "/*" else -1
                at = c.end()
            continue
        out.append(_WORDS.get(m.group(), "ID") if kind == "id" else m.group() if kind == "op" else kind.upper())
    yield from out


def valid(text: str, chunk_type: str) -> bool:
    """Whether the text is a source file, or one item (of an impl, too) or expression."""
    return _GRAMMAR.accepts(tokens(text), "file" if chunk_type == "file" else "unit")
