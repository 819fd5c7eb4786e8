"""Grammar of Rust."""

from __future__ import annotations

import re

from tessera.llm.grammar import Grammar

_WORDS = """as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref
return self Self static struct super trait true type unsafe use where while union default macro_rules _"""
_SIGNS = """; , . .. ... ..= : :: -> => = += -= *= /= %= &= |= ^= <<= == != < > <= << + - * / % & | ^ ! && || ? @ # $ ~"""
_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*)
    |(?P<block>/\*)
    |(?P<string>(?:b|c)?"(?:\\[\s\S]|[^"\\])*"|(?:b|c)?r(?P<h>\#*)"[\s\S]*?"(?P=h)|b?'(?:\\x[\da-fA-F]{2}|\\u\{[\da-fA-F_]+\}|\\.|[^'\\\n])')
    |(?P<life>'[^\W\d]\w*|'_)
    |(?P<word>(?:r\#)?[^\W\d]\w*)
    |(?P<number>(?:0x[\da-fA-F_]+|0b[01_]+|0o[0-7_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+-]?\d+)?)(?:[iu](?:8|16|32|64|128|size)|f(?:32|64))?(?!\w))
    |(?P<sign>\.\.\.|\.\.=|\.\.|<<=|::|->|=>|==|!=|<=|<<|&&|\|\||[-+*/%&|^]=|[;,.:=<>+\-*/%&|^!?@\#$~(){}\[\]])
    |(?P<bad>[\s\S])""",
    re.VERBOSE,
)
_COMMENT = re.compile(r"/\*|\*/")


def _without_comments(text: str) -> str | None:
    """Block comments nest; None where one doesn't end. Only called where a text has one outside of strings."""
    depth, out, at = 0, [], 0
    for m in _COMMENT.finditer(text):
        if m.group() == "/*":
            if not depth:
                out.append(text[at : m.start()])
            depth += 1
        elif depth:
            depth -= 1
            at = m.end()
    return None if depth else "".join([*out, " ", text[at:]])


def tokens(text: str, g: Grammar) -> list[str] | None:
    out: list[str] = []
    chars = g.chars
    text = text.removeprefix("﻿")
    if text.startswith("#!") and not text.startswith("#!["):
        text = text.partition("\n")[2]
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "skip" or kind == "h":
            continue
        if kind == "block":
            rest = _without_comments(text[m.start() :])
            if rest is None:
                return None
            more = tokens(rest, g)
            return None if more is None else out + more
        if kind == "bad":
            return None
        s = m.group()
        if kind == "word":
            out.append(chars.get(s, "i"))
        elif kind == "number":
            out.append("n")
        elif kind == "string":
            out.append("s")
        elif kind == "life":
            out.append("q")
        else:
            out.append(s if s in "(){}[]" else chars[s])
    return out


def _build() -> Grammar:
    g = Grammar({"(": ["PA", "PT", "PF", "PP", "PX"], "[": ["KA", "KT", "KX"], "{": ["BB", "BO", "BM", "BI", "BE", "BU", "BX"]}, _WORDS, _SIGNS)
    g.cls("ID", "union default macro_rules", "i")
    g.cls("SEG", "self Self super crate union default macro_rules", "i")
    g.cls("BINOP", "= += -= *= /= %= &= |= ^= <<= == != < <= << + - * / % & | ^ && ||")
    g.rule("ATTRS", "(?:'#''!'?%ANYK)*")
    g.rule("VIS", "(?:'pub'(?:%ANYP)?)?")
    g.rule("PATH", "'::'?%SEG(?:'::'?Λ)?(?:'::'%SEG(?:'::'?Λ)?)*")
    g.rule("TPATH", "%PATH(?:(?:%PT|%PA)(?:'->'%SEG Λ?)?)?")
    g.rules["T"] = "(?&T)"
    g.defined["T"] = "(?!)"
    bound = "(?:q|'?'?'~'?'const'?(?:'for'Λ)?%TPATH|%PT)"
    g.rule("BOUNDS", f"{bound}(?:'+'{bound})*'+'?")
    g.defined["T"] = g.expand("(?>(?:'&'q?'mut'?|'&&'q?'mut'?|'*'(?:'const'|'mut'))*)(?:(?:'impl'|'dyn')%BOUNDS|'unsafe'?(?:'extern's?)?'fn'(?:%PT|%PF|%PA)(?:'->'(?&T))?|%TPATH(?:'+'%BOUNDS)?|%PT|%KT|'!'|'_'|Λ'::'%PATH|(?:'for'Λ)(?&T))")
    targ = "(?:q(?:':'(?:q(?:'+'q)*)?)?|'const'%ID':'%T(?:'='(?:n|%BB))?|%ID Λ?(?:':'%BOUNDS)?'='%T|%ID':'(?:%BOUNDS)?|%T(?:'as'%T)?|n|s|'-'n|%BB|'true'|'false')"
    g.reduce = g.compile(g.expand(f"(?<=%ID|'impl'|'::'|'for'|'Self')'<'(?:{targ}(?:','{targ})*','?)?'>'|(?<![insΛ]|%ANYP|%ANYK|%ID)'<'%T(?:'as'%T)?'>'(?='::')"))
    g.rule("WHERE", f"(?:'where'(?:(?:q|(?:'for'Λ)?%T)':'(?:%BOUNDS)?','?)*)?")
    pat1 = "(?:'&''mut'?|'&&''mut'?|'ref''mut'?|'mut'|%ID'@'|'box')*(?:'-'?n|s|'true'|'false'|'_'|%PATH(?:%PP|%PA|%BO|%BU)?|%PP|%PA|%KA|%KT|'..')(?:(?:'..='|'...'|'..')(?:'-'?n|s|%PATH)?)?".replace("|'box'", "")
    g.rule("PAT", f"'|'?{pat1}(?:'|'{pat1})*")
    g.rule("PATN", pat1)
    g.rule("MACRO", "%PATH'!'%ID?(?:%ANYP|%ANYK|%ANYB)")
    g.rules["EN"] = "(?&EN)"
    g.rules["E"] = "(?&E)"
    g.defined["EN"] = g.defined["E"] = "(?!)"
    let = "'let'%PAT'='"
    cond = f"(?:{let})?%EN(?:'&&'{let}%EN)*"
    g.rule("BLOCKY", f"(?:q':')?(?:'unsafe'%BB|'async''move'?%BB|'const'%BB|%BB|'if'{cond}%BB(?:'else''if'{cond}%BB)*(?:'else'%BB)?|'match'%EN%BM|'loop'%BB|'while'{cond}%BB|'for'%PAT'in'%EN%BB)")
    closure = "(?:'async'?'move'?(?:'||'|'|'(?:%PATN(?:':'%T)?(?:','%PATN(?:':'%T)?)*','?)?'|')(?:'->'%T)?)"
    pre = f"(?:'!'|'-'|'*'|'&''mut'?|'&&''mut'?|{closure}|'..'|'..='|'&''raw'(?:'const'|'mut'))".replace("|'&''raw'(?:'const'|'mut')", "")
    jump = "(?:'return'|'break'q?|'continue'q?)"
    post = "(?:'.'(?:%ID|n|'await')(?:'::'Λ)?|%PA|%KA|'?'|'as'%T)"
    prim = f"(?:%BLOCKY|%MACRO|Λ'::'%PATH|%PATH|n|s|'true'|'false'|%PA|%KA|'_')"
    g.rule("PRE", pre)
    g.rule("POST", post)
    g.rule("OP", "%BINOP|'>''>'?'='?|'..='|'..'")
    g.rule("PRIM", prim)
    g.rule("PRIMS", f"%PATH%BO|{prim}")
    one = "(?>%PRE*)%PRIM(?>%POST*)"
    ones = "(?>%PRE*)(?:%PRIMS)(?>%POST*)"
    g.defined["EN"] = g.expand(f"(?>{one}(?>(?:%OP)(?:{one}))*(?:'..')?)|'..'")
    g.defined["E"] = g.expand(f"(?>(?:{jump}(?:{ones})?|{ones})(?>(?:%OP)(?:{jump}(?:{ones})?|{ones}))*(?:'..')?)|'..'")
    # contents of pairs
    for x in ("PX", "KX", "BX"):
        g.rule("in" + x, r"[^\n]*")
    g.rule("inPA", "(?:%ATTRS%E(?:','%ATTRS%E)*','?)?")
    tup = "%ATTRS%VIS%T"
    g.rule("inPT", f"(?:{tup}(?:','{tup})*','?)?")
    par = "%ATTRS(?:(?:'&'q?)?'mut'?'self'(?:':'%T)?|%PAT':'%T|'...')"
    g.rule("inPF", f"(?:{par}(?:','{par})*','?)?")
    g.rule("inPP", "(?:%PAT(?:','%PAT)*','?)?")
    g.rule("inKA", "(?:%E(?:','%E)*','?|%E';'%E|%PAT(?:','%PAT)*','?)?")
    g.rule("inKT", "%T(?:';'%E)?")
    field = "%ATTRS(?:(?:%ID|n)(?:':'%E)?|(?:'ref'|'mut')*%ID|(?:%ID|n)':'%PAT|'..'%E?)"
    g.rule("inBO", f"(?:{field}(?:','{field})*','?)?")
    decl = "%ATTRS%VIS%ID':'%T"
    g.rule("FIELDS", f"(?:{decl}(?:','{decl})*','?)?")
    g.rule("inBU", "%FIELDS|(?:(?:%PATH|'*'|%BU)(?:'::'(?:'*'|%BU))?(?:'as'(?:%ID|'_'))?(?:','(?:(?:%PATH|'*'|%BU)(?:'::'(?:'*'|%BU))?(?:'as'(?:%ID|'_'))?))*','?)?")
    arm = "%ATTRS%PAT(?:'if'%E)?'=>'"
    g.rule("inBM", f"(?:{arm}(?:%BLOCKY(?:','|(?=$|'#'|'|'|'&'|i|n|s|%PA|%PP|'_'|'..'|%SEG|'ref'|'mut'|'-'|'true'|'false'))|%E(?:','|$)))*")
    var = "%ATTRS%ID(?:%PT|%PA|%BU|%BO)?(?:'='%E)?"
    g.rule("inBE", f"(?:{var}(?:','{var})*','?)?")
    g.rule("SIG", "'default'?'const'?'async'?'unsafe'?(?:'extern's?)?'fn'%ID Λ?%PF(?:'->'%T)?%WHERE")
    use = "'use'(?:'::'?(?:%SEG'::')*(?:'*'|%BU|%SEG)(?:'as'(?:%ID|'_'))?)';'"
    item = (
        f"%ATTRS%VIS(?:{use}|'mod'%ID(?:';'|%BI)|%SIG(?:%BB|';')|'const'(?:%ID|'_')':'%T(?:'='%E)?';'|'static''mut'?%ID':'%T(?:'='%E)?';'"
        f"|'type'%ID Λ?(?:':'%BOUNDS)?%WHERE(?:'='%T)?';'|'struct'%ID Λ?(?:%WHERE%BU|(?:%PT|%PA)%WHERE';'|%WHERE';')|'union'%ID Λ?%BU|'enum'%ID Λ?%WHERE%BE"
        f"|'unsafe'?'impl'Λ?'!'?(?:%T'for')?%T%WHERE%BI|'unsafe'?'trait'%ID Λ?(?:':'%BOUNDS)?%WHERE%BI|'extern''crate'%ID(?:'as'%ID)?';'|'unsafe'?'extern's?%BI"
        f"|%PATH'!'%ID?(?:%ANYB|(?:%ANYP|%ANYK)';'))"
    )
    g.rule("ITEM", item)
    g.rule("inBI", "(?:%ITEM)*")
    stmt = "(?:';'|%ITEM|%ATTRS(?:'let'%PAT(?:':'%T)?(?:'='%E(?:'else'%BB)?)?';'|%BLOCKY(?![.?'])|%E';'))".replace("(?![.?'])", "(?!'.'|'?')")
    g.rule("inBB", f"(?>(?:{stmt})*)(?:%ATTRS%E)?|(?>(?:{stmt})*)")
    g.rule("FILE", "(?:'#''!'%ANYK)*(?:%ITEM|';')*")
    g.finish("FILE")
    g.repeats("BB", ";")
    for name in ("BI", ""):
        g.repeats(name, ";", "{")
    return g


RUST = _build()


def parses(text: str) -> bool:
    """Whether a text is a Rust source file."""
    t = tokens(text, RUST)
    return t is not None and RUST.accepts(t)
