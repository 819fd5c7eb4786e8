"""Grammar of Java."""

from __future__ import annotations

import re

from tessera.llm.grammar import _BASE, Grammar

_WORDS = """package import static class interface enum record extends implements permits throws public protected private final abstract
native synchronized transient volatile strictfp default sealed return if else for while do switch case break continue try catch
finally throw new this super null true false instanceof assert void yield var when"""
_SIGNS = """; , . ... : :: ? -> = += -= *= /= %= &= |= ^= <<= == != < > <= << + - * / % & | ^ ! ~ && || ++ -- @ @interface"""
_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*[\s\S]*?\*/)
    |(?P<annotation>@interface\b)
    |(?P<word>[^\W\d][\w$]*|\$[\w$]*)
    |(?P<number>(?:0[xX][\da-fA-F_]+(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?![\w$]))
    |(?P<string>\"\"\"[ \t]*\n(?:\\[\s\S]|[^\\])*?\"\"\"|"(?:\\.|[^"\\\n])*"|'(?:\\u+[\da-fA-F]{4}|\\[0-7]{1,3}|\\.|[^'\\\n])')
    |(?P<sign>\.\.\.|->|::|<<=|==|!=|<=|<<|&&|\|\||\+\+|--|[-+*/%&|^]=|[;,.:?=<>+\-*/%&|^!~@(){}\[\]])
    |(?P<bad>[\s\S])""",
    re.VERBOSE,
)


def tokens(text: str, g: Grammar) -> list[str] | None:
    out: list[str] = []
    chars = g.chars
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "skip":
            continue
        if kind == "bad":
            return None
        s = m.group()
        if kind == "word":
            out.append(chars.get(s, "i"))
        elif kind == "number":
            out.append("n")
        elif kind == "string":
            out.append("s")
        else:
            out.append(s if s in "(){}[]" else chars[s])
    return out


def _build() -> Grammar:
    g = Grammar({"(": ["PA", "PF", "PT", "PR"], "[": ["KA", "KE"], "{": ["BB", "BC", "BE", "BA", "BW", "BM"]}, _WORDS, _SIGNS)
    g.cls("ID", "record permits sealed yield var when", "i")
    g.cls("MODW", "public protected private static final abstract native synchronized transient volatile strictfp default sealed")
    g.cls("ASSIGN", "= += -= *= /= %= &= |= ^= <<=")
    g.cls("BINOP", "= += -= *= /= %= &= |= ^= <<= == != < <= << + - * / % & | ^ && ||")
    g.rule("QN", "%ID(?:'.'%ID)*")
    g.rule("ANNO", "'@'%QN%PA?")
    g.rule("ANNOS", "(?:%ANNO)*")
    g.rule("MODS", "(?:%MODW|%ANNO|%ID'-'%ID)*")
    g.rule("TYPE", "%ANNOS(?:%ID Λ?(?:'.'%ANNOS%ID Λ?)*)(?:%ANNOS%KE)*")
    g.rule("RTYPE", "%TYPE|'void'")
    g.rule("TYPES", "%TYPE(?:','%TYPE)*")
    g.rule("TARG", "(?:%ANNOS'?'(?:(?:'extends'|'super')%TYPE(?:'&'%TYPE)*)?|%TYPE(?:'extends'%TYPE(?:'&'%TYPE)*)?)")
    g.reduce = g.compile(g.expand("'<'(?:%TARG(?:','%TARG)*)?'>'(?!n|s|'-'|'!')"))
    g.rule("CREATE", "'new'%ANNOS(?:%ID Λ?(?:'.'%ID Λ?)*)(?:%PA%BC?|%KA+%KE*|%KE+%BA)")
    g.rule("LAMBDA", "(?:%ID|%PF)'->'")
    g.rule("PRE", "(?>%LAMBDA|'!'|'~'|'+'|'-'|'++'|'--'|%PT(?=[insΛ]|%ID|%PA|'this'|'super'|'new'|'null'|'true'|'false'|'!'|'~'|'switch'|%LAMBDA))")
    g.rule("PRIM", "%CREATE|%TYPE'::'(?:%ID|'new')|%TYPE'.''class'|'void''.''class'|%ID|'this'%PA?|'super'%PA?|'null'|'true'|'false'|n|s|%PA|'switch'%PA%BW|(?<='->')%BB")
    g.rule("POST", "'.'(?:Λ?%ID|%CREATE|'this'|'super'|'class')|%KA|%PA|'++'|'--'|Λ?'::'(?:%ID|'new')")
    g.rule("OP", "%BINOP|'>''>'?'>'?'='?")
    g.rule("OPERAND", "(?>%PRE*)%PRIM(?>%POST*)(?:'instanceof''final'?%TYPE(?:%PR|%ID)?)?")
    g.rule("B", "(?>%OPERAND(?>(?:%OP)%OPERAND)*)")
    g.rule("E", "(?>%B(?>'?'%B(?:'?'%B':'%B)?':'%B)*)")
    g.rule("INIT", "%E|%BA")
    # contents of pairs
    named = "%ID'='(?:%INIT|%ANNO)"
    g.rule("inPA", f"(?:{named}(?:','{named})*|%INIT(?:','%E)*|%ANNO)?")
    param = "(?:'final'|%ANNO)*(?:%TYPE(?:'...')?(?:%ID|'this')%KE*|%ID)"
    g.rule("inPF", f"(?:{param}(?:','{param})*)?")
    g.rule("inPT", "%TYPE(?:'&'%TYPE)*")
    pattern = "(?:'final'|%ANNO)*%TYPE(?:%PR)?%ID?"
    g.rule("inPR", f"(?:{pattern}(?:','{pattern})*)?")
    decls = "%ID%KE*(?:'='(?:%INIT))?"
    g.rule("LOCAL", f"(?:'final'|%ANNO)*%TYPE{decls}(?:','{decls})*")
    res = f"(?:%LOCAL|%E)"
    g.rule("inKA", "%E")
    g.rule("inKE", "")
    g.rule("inBA", "(?:(?:%INIT|%ANNO)(?:','(?:%INIT|%ANNO))*','?)?|','")
    body = "(?:'extends'%TYPES)?(?:'implements'%TYPES)?(?:'permits'%TYPES)?"
    g.rule("TYPEDECL", f"%MODS(?:(?:'class'|'interface'|'@interface')%ID Λ?{body}%BC|'enum'%ID{body}(?:%BE|%BC)|'record'%ID Λ?%PF{body}%BC)")
    member = f"(?:';'|'static'?%BB|%TYPEDECL|%MODS Λ?%MODS(?:%RTYPE)?%ID(?:%PF|%PA)%KE*(?:'throws'%TYPES)?(?:%BB|';'|'default'(?:%INIT|%ANNO)';')|%MODS%ID%BB|%MODS%TYPE{decls}(?:','{decls})*';')"
    g.rule("inBC", f"(?:{member})*")
    const = "%ANNOS%ID%PA?%BC?"
    g.rule("inBE", f"(?:{const}(?:','{const})*','?)?(?:';'(?:{member})*)?")
    # an expression that is a statement assigns, calls, creates or counts
    ends = "".join(chr(_BASE["("] + m) + "-" + chr(_BASE["("] + m + 255) for m in (0,)) + "".join(re.escape(g.chars[x]) for x in ("++", "--")) + g.rules["BC"][1:-1]
    g.rule("SE", f"(?:'++'|'--')?(?>%PRIM(?>%POST*))(?:(?:%ASSIGN|'>''>''>'?'=')(?:%INIT)|(?<=[{ends}]))|(?:'++'|'--')%OPERAND")
    head = "(?:'for'%ANYP|'while'%PA|'do'|%ID':'(?!':'))"
    simple = (
        "(?:';'|%BB|%TYPEDECL|%LOCAL';'|'return'%E?';'|'throw'%E';'|(?:'break'|'continue')%ID?';'|'yield'%E';'|'assert'%E(?:':'%E)?';'|'while'%PA';'"
        "|'try'(?:%ANYP)?%BB(?:'catch'%ANYP%BB)*(?:'finally'%BB)?|'switch'%PA%BW|'synchronized'%PA%BB|%SE';')"
    )
    g.defined["STMT"] = "(?!)"
    g.rules["STMT"] = "(?&STMT)"
    g.defined["STMT"] = g.expand(f"(?>(?:{head})*(?:'if'%PA(?&STMT)(?:'else'(?&STMT))?|{simple}))")
    g.rule("inBB", "(?:%STMT)*")
    label = "(?:'case'(?:'null'|%LOCAL|%TYPE%PR?%ID?|%E)(?:','(?:%TYPE%PR?%ID|%E|'default'))*(?:'when'%E)?|'default')"
    g.rule("inBW", f"(?:{label}(?:':'(?:%STMT)*|'->'(?:%BB|'throw'%E';'|%E';')))*")
    # heads of for, try and catch share the parentheses: one of the readings above, or one of these
    heads = f"(?:(?:%LOCAL|%E(?:','%E)*)?';'%E?';'(?:%E(?:','%E)*)?|(?:'final'|%ANNO)*%TYPE%ID':'%E|{res}(?:';'{res})*';'?|(?:'final'|%ANNO)*%TYPE(?:'|'%TYPE)*%ID)"
    g.rules["inPR"] = f"(?:{g.rules['inPR']}|{g.expand(heads)})"
    g.rule("inBM", "(?:i(?:'static'|i(?!'.'|';'|i';'))*%QN(?:i%QN(?:','%QN)*)?';')*")
    g.rule("UNIT", "(?:%ANNOS'package'%QN';')?(?:'import''static'?%QN(?:'.''*')?';'|';')*(?:(?:%TYPEDECL|';')*|%ANNOS i?i%QN%BM';'*)")
    g.finish("UNIT")
    for name in ("BB", "BC"):
        g.repeats(name, ";", "{")
    return g


JAVA = _build()


def parses(text: str) -> bool:
    """Whether a text is a Java compilation unit."""
    t = tokens(text, JAVA)
    return t is not None and JAVA.accepts(t)
