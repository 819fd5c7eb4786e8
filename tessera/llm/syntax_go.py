"""Grammar of Go."""

from __future__ import annotations

import re

from tessera.llm.grammar import Grammar

_WORDS = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
_SIGNS = "; , . ... : := = += -= *= /= %= &= |= ^= <<= >>= &^= == != < > <= >= << >> + - * / % & | ^ &^ ! ~ && || ++ -- <-"
_TOKEN = re.compile(
    r"""(?P<skip>[ \t\r]+)
    |(?P<newline>\n|//[^\n]*)
    |(?P<block>/\*[\s\S]*?\*/)
    |(?P<word>[^\W\d]\w*)
    |(?P<number>(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?(?!\w))
    |(?P<string>`[^`]*`|"(?:\\.|[^"\\\n])*"|'(?:\\x[\da-fA-F]{2}|\\u[\da-fA-F]{4}|\\U[\da-fA-F]{8}|\\[0-7]{3}|\\.|[^'\\\n])')
    |(?P<sign>\.\.\.|:=|&\^=|&\^|<<=|>>=|<-|==|!=|<=|>=|<<|>>|&&|\|\||\+\+|--|[-+*/%&|^]=|[;,.:=<>+\-*/%&|^!~(){}\[\]])
    |(?P<bad>[\s\S])""",
    re.VERBOSE,
)


def tokens(text: str, g: Grammar) -> list[str] | None:
    """Token characters with the semicolons that line ends stand for."""
    out: list[str] = []
    chars, semi, ends = g.chars, g.chars[";"], g.ends
    for m in _TOKEN.finditer(text.removeprefix("﻿")):
        kind = m.lastgroup
        if kind == "skip":
            continue
        s = m.group()
        if kind == "newline" or kind == "block":
            if (s == "\n" or kind == "block" and "\n" in s) and out and out[-1] in ends:
                out.append(semi)
            continue
        if kind == "bad":
            return None
        if kind == "word":
            out.append(chars.get(s, "i"))
        elif kind == "number":
            out.append("n")
        elif kind == "string":
            out.append("s")
        else:
            out.append(s if s in "(){}[]" else chars[s])
    if out and out[-1] in ends:
        out.append(semi)
    return out


def _build() -> Grammar:
    g = Grammar({"(": ["PA", "PF", "PI", "PV", "PT"], "[": ["KA", "KT"], "{": ["BB", "BL", "BS", "BI", "BW"]}, _WORDS, _SIGNS)
    g.ends = set("ins)]}") | {g.chars[w] for w in "break continue fallthrough return ++ --".split()}
    g.cls("BINOP", "== != < > <= >= << >> + - * / % & | ^ &^ && ||")
    g.cls("ASSIGN", "= := += -= *= /= %= &= |= ^= <<= >>= &^=")
    g.rule("QN", "i(?:'.'i)?")
    g.rule("TPRE", "(?:'*'|%KA|%KT|'map'(?:%KA|%KT)|'<-'?'chan''<-'?|'...')*")
    g.defined["TYPE"] = "(?!)"
    g.rules["TYPE"] = "(?&TYPE)"
    g.defined["TYPE"] = g.expand("(?>%TPRE)(?:%QN(?:%KA|%KT)?|'struct'%BS|'interface'%BI|'func'%PF(?:(?&TYPE)|%PF)?|%PT)")
    g.rule("RESULT", "(?:%TYPE|%PF)")
    lit = "'func'%PF(?:%RESULT)?%BB"
    comp = "(?:(?:%KA|%KT)+(?:'*')?%QN|(?:%KA|%KT)*'map'(?:%KA|%KT)%TYPE|(?:%KA|%KT)*'struct'%BS|(?:%KA|%KT)+(?:'map'(?:%KA|%KT)%TYPE|'func'%PF(?:%RESULT)?|'interface'%BI))"
    post = "'.'(?:i|%PT|%ANYP)|%KA|%KT|%PA"
    pre = "'+'|'-'|'!'|'^'|'*'|'&'|'<-'|'~'"
    g.rule("COMP", comp)
    g.rule("PRIMN", f"{lit}|%COMP(?:%BL|%PA)|'struct'%BS%BL|'interface'%BI%PA|'chan'%TYPE%PA|i|n|s|%PA|%PT")
    g.rule("EN", f"(?>(?>(?:{pre})*)%PRIMN(?>(?:{post})*)(?>%BINOP(?>(?:{pre})*)%PRIMN(?>(?:{post})*))*)")  # of headers: no composite literal of a bare type
    g.rule("ONE", f"(?>(?:{pre})*)(?:%QN(?:%KT|%KA)?%BL|%PRIMN)(?>(?:{post}|(?<=i)%BL)*)")
    g.rule("E", "(?>%ONE(?>%BINOP%ONE)*)")
    g.rule("EL", "%E(?:','%E)*")
    g.rule("ENL", "%EN(?:','%EN)*")
    # contents of pairs
    arg = "(?:%E|%TYPE)(?:'...')?"
    g.rule("inPA", f"(?:{arg}(?:','{arg})*','?)?")
    par = "(?:i?(?:%TYPE))"
    g.rule("inPF", f"(?:{par}(?:','{par})*','?)?")
    g.rule("inPT", "%TYPE|'type'")
    spec = "(?:'.'|i)?s"
    g.rule("inPI", f"(?:{spec}(?:';'|$))*")
    value = "i(?:','i)*(?:%TYPE)?(?:'='%EL)?"
    alias = "i(?:%KA|%KT)?'='?%TYPE"
    g.rule("inPV", f"(?:(?:{value}|{alias})(?:';'|$))*")
    g.rule("inKA", "(?:%E|'...')?|%E?':'%E?(?:':'%E)?")
    g.rule("inKT", "(?:i(?:','i)*)?'~'?%TYPE(?:'|''~'?%TYPE)*(?:','(?:i(?:','i)*)?'~'?%TYPE(?:'|''~'?%TYPE)*)*','?")
    item = "(?:%E|%BL)(?:':'(?:%E|%BL))?"
    g.rule("inBL", f"(?:{item}(?:','{item})*','?)?")
    field = "(?:i(?:','i)*%TYPE|'*'?%QN(?:%KA|%KT)?)s?"
    g.rule("inBS", f"(?:{field}(?:';'|$))*")
    g.rule("inBI", "(?:(?:i%PF(?:%RESULT)?|'~'?%TYPE(?:'|''~'?%TYPE)*)(?:';'|$))*")
    g.rule("DECL", f"'var'(?:{value}|%PV)|'const'(?:{value}|%PV)|'type'(?:{alias}|%PV)")
    act = "(?:%EL(?:%ASSIGN%EL|'++'|'--'|'<-'%E)?|%EL)"
    actn = "(?:%ENL(?:%ASSIGN'range'?%ENL|'++'|'--'|'<-'%EN)?|'range'%EN)"
    iff = f"'if'(?:{actn}?';')?%EN%BB"
    ctl = (
        f"(?:{iff}'else')*{iff}(?:'else'%BB)?|'for'(?:{actn}?';'%EN?';'{actn}?|{actn})?%BB|'switch'(?:{actn}?';')?(?:{actn})?%BW|'select'%BW"
    )
    simple = f"%BB|%DECL|'go'%E|'defer'%E|'return'%EL?|(?:'break'|'continue'|'goto')i?|'fallthrough'|{ctl}|{act}"
    g.rule("STMT", f"(?:i':'';'?)*(?:{simple})?")
    g.rule("STMTS", "(?>(?:%STMT(?:';'))*)(?:%STMT)?")
    g.rule("inBB", "%STMTS")
    comm = "(?:(?:%E|%TYPE)(?:','(?:%E|%TYPE))*(?:%ASSIGN%EL|'<-'%E)?)"
    g.rule("inBW", f"(?:(?:'case'{comm}|'default')':'%STMTS)*")
    func = "'func'%PF?i(?:%KA|%KT)?%PF(?:%RESULT)?%BB?"
    g.rule("FILE", f"';'*'package'i';'(?:'import'(?:{spec}|%PI)';'|';')*(?:(?:%DECL|{func})';'|';')*")
    g.finish("FILE")
    g.repeats("BB", ";")
    return g


GO = _build()


def parses(text: str) -> bool:
    """Whether a text is a Go source file."""
    t = tokens(text, GO)
    return t is not None and GO.accepts(t)
