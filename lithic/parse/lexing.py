"""Tokens of the brace languages and Fortran, by one table a language. Offsets are UTF-8 bytes after lossy decoding."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

WORD = r"[A-Za-z_][A-Za-z0-9_]*"
NUMBER = r"0[xX][0-9a-fA-F_']+[uUlLiIsz0-9]*|0[bB][01_']+[uUlLiIsz0-9]*|0[oO][0-7_]+[a-z0-9]*|(?:[0-9][0-9_']*)(?:\.(?![.A-Za-z_])[0-9_']*)?(?:[eEdD][+-]?[0-9]+)?(?:_?[a-zA-Z][a-zA-Z0-9_]*)?|\.[0-9]+(?:[eEdD][+-]?[0-9]+)?[fFlL]?"
C_STRING = r'(?:u8|[uUL])?"(?:\\.|[^"\\\n])*"'
C_CHAR = r"(?:u8|[uUL])?'(?:\\.|[^'\\\n])+'"
SIGNS = ["<<=", ">>=", "...", "->*", "::", "->", "++", "--", "<<", ">>", "<=", ">=", "==", "!=", "&&", "||", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="]


@dataclass(frozen=True)
class Language:
    name: str
    comments: str
    strings: str
    chars: str = r"(?!)"
    word: str = WORD
    number: str = NUMBER
    signs: tuple = ()
    keywords: frozenset = frozenset()
    bools: tuple = ("true", "false")
    short_circuit: tuple = ("&&", "||")
    flags: int = 0
    extra: dict = field(default_factory=dict, hash=False)


def words(text: str) -> frozenset:
    return frozenset(text.split())


C_WORDS = "if else for while do switch case default return goto break continue sizeof struct union enum typedef static const extern inline volatile register signed unsigned asm"
LANGUAGES = {
    "c": Language("c", r"//[^\n]*|/\*.*?(?:\*/|\Z)", C_STRING, C_CHAR, keywords=words(C_WORDS)),
    "cpp": Language("cpp", r"//[^\n]*|/\*.*?(?:\*/|\Z)", r'R"(?P<cd>[^()\s]{0,16})\(.*?\)(?P=cd)"|' + C_STRING, C_CHAR, keywords=words(C_WORDS + " class public private protected virtual override template typename namespace using try catch throw new delete operator constexpr noexcept auto explicit friend mutable this final")),
    "java": Language("java", r"//[^\n]*|/\*.*?(?:\*/|\Z)", r'""".*?"""|"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])+'", signs=(">>>=", ">>>"), keywords=words("if else for while do switch case default return break continue class interface record enum extends implements public private protected static final abstract native synchronized transient volatile strictfp throws throw try catch finally new instanceof import package this super yield assert")),
    "rust": Language("rust", r"//[^\n]*|/\*.*?(?:\*/|\Z)", r'b?r(?P<rd>#{0,16})".*?"(?P=rd)|b?"(?:\\.|[^"\\])*"', r"b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^'\\\n])'", signs=("..=", "=>", ".."), keywords=words("if else for while loop match return break continue fn let mut pub use mod struct enum union impl trait where unsafe extern const static as in ref move async await dyn crate type self Self super")),
    "r": Language("r", r"#[^\n]*", r'"(?:\\.|[^"\\])*"|' + r"'(?:\\.|[^'\\])*'", word=r"[A-Za-z.][A-Za-z0-9._]*|`[^`\n]+`", signs=("<<-", "->>", "<-", ":::", "%%", "%in%", "|>"), keywords=words("if else for while repeat function return break next in"), bools=("TRUE", "FALSE"), short_circuit=("&&", "||", "&", "|")),
    "perl": Language("perl", r"(?m:^=[a-z].*?(?:^=cut[^\n]*|\Z))|#[^\n]*", r'"(?:\\.|[^"\\])*"|' + r"'(?:\\.|[^'\\])*'|\bqw\s*\([^)]*\)|\bqw\s*/[^/]*/|\bq[qx]?\s*\{[^}]*\}", word=r"[$@%&]?\$?[A-Za-z_](?:[A-Za-z0-9_]|::(?=[A-Za-z_]))*|[$@]_\b|\$[0-9&!/,;.]|\$#?\{?[A-Za-z_]\w*\}?", signs=("<=>", "=~", "!~", "**=", "||=", "&&=", "//=", "//", "**", "=>", "..", "x="), keywords=words("if elsif else unless while until for foreach do sub my our local return last next redo package use no and or not eq ne lt gt le ge cmp try catch"), bools=(), short_circuit=("&&", "||", "//", "and", "or")),
    "fortran": Language("fortran", r"![^\n]*", r'"(?:""|[^"\n])*"|' + r"'(?:''|[^'\n])*'", number=r"[0-9]+\.(?![a-zA-Z]{2,}\.)[0-9]*(?:[eEdD][+-]?[0-9]+)?(?:_\w+)?|[0-9]+(?:[eEdD][+-]?[0-9]+)?(?:_\w+)?|\.[0-9]+(?:[eEdD][+-]?[0-9]+)?", signs=(".and.", ".or.", ".not.", ".eqv.", ".neqv.", ".eq.", ".ne.", ".lt.", ".le.", ".gt.", ".ge.", "**", "//", "==", "/=", "<=", ">=", "::", "=>", "(/", "/)"), bools=(".true.", ".false."), short_circuit=(".and.", ".or.", ".eqv.", ".neqv."), flags=re.I),
}


@dataclass
class Token:
    kind: str  # comment, string, char, number, word, sign, label
    text: str
    start: int
    end: int
    row: int
    end_row: int


@lru_cache
def scanner(name: str):
    lang = LANGUAGES[name]
    signs = "|".join(re.escape(s) for s in sorted({*SIGNS, *lang.signs, *(b for b in lang.bools if b[0] == ".")}, key=len, reverse=True))
    parts = [("comment", lang.comments), ("string", lang.strings), ("char", lang.chars), ("number", lang.number), ("word", lang.word), ("sign", signs + r"|[^\s]")]
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in parts), re.S | lang.flags)


def tokens(text: str, name: str) -> list[Token]:
    """All tokens in order. Preprocessor lines of C and C++ are left out, as far as their continuation lines go."""
    if name in ("c", "cpp"):
        text = re.sub(r"(?m)^[ \t]*#(?:[^\n\\]|\\\n|\\.)*", lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    out, row, at, byte = [], 0, 0, 0
    for m in scanner(name).finditer(text):
        row += text.count("\n", at, m.start())
        byte += len(text[at : m.start()].encode("utf-8", "surrogatepass"))
        size, rows = len(m[0].encode("utf-8", "surrogatepass")), m[0].count("\n")
        out.append(Token(m.lastgroup if m.lastgroup not in ("cd", "rd") else "string", m[0], byte, byte + size, row, row + rows))
        row, at, byte = row + rows, m.end(), byte + size
    return out
