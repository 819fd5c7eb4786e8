"""Grammar of JavaScript modules and of TypeScript."""

from __future__ import annotations

import re

from tessera.llm.grammar import Grammar

_WORDS = """function class extends return if else for while do switch case default break continue try catch finally throw new
delete typeof void in instanceof this super null true false var let const import export yield await debugger with
of get set static async as from type interface enum declare abstract private public protected readonly override implements
namespace module keyof infer unique asserts is satisfies global accessor"""
_CONTEXTUAL = "of get set static async as from type interface declare abstract private public protected readonly override implements namespace module keyof infer unique asserts is satisfies global accessor let"
_SIGNS = """; , . ?. ... : ? => = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= == != === !== < > <= >= << + - * / % ** & | ^ ! ~ && || ?? ++ -- @"""
#: Words that a module, being strict, keeps from being names.
_STRICT = frozenset("let static implements private public protected interface".split())
_ASSIGN = "= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??="
_BINARY = "== != === !== < <= << + - * / % ** & | ^ && || ?? in instanceof"

_REGEX = r"/(?![/*])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[A-Za-z]*"
_HOLE = r"\$\{(?:[^{}`'\"]|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\"|`(?:\\.|[^`\\])*`|\{[^{}]*\})*\}"
_TOKEN = re.compile(
    rf"""(?P<skip>[ \t\r\f\v ﻿]+|//[^\n]*)
    |(?P<block>/\*[\s\S]*?\*/)
    |(?P<newline>\n)
    |(?P<regex>(?:=>|&&|\|\||\?\?|[=!]==?|[-(,=:\[!&|?{{}};+*%~^<>]|\breturn\b|\btypeof\b)\s*{_REGEX})
    |(?P<word>\#?[^\W\d][\w$]*|\#?\$[\w$]*)
    |(?P<number>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$]))
    |(?P<string>"(?:\\[\s\S]|[^"\\\n])*"|'(?:\\[\s\S]|[^'\\\n])*')
    |(?P<template>`(?:\\[\s\S]|[^`\\$]|\$(?!\{{)|{_HOLE})*`)
    |(?P<sign>\.\.\.|=>|\*\*=|\*\*|<<=|&&=|\|\|=|\?\?=|===|!==|==|!=|<=|<<|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|[-+*/%&|^]=|[;,.:?=<>+\-*/%&|^!~@(){{}}\[\]])
    |(?P<bad>[\s\S])""",
    re.VERBOSE,
)
_CLOSED = "\ue000-\ue2ffΛ"  # reduced pairs and type arguments
_PARTS = re.compile(rf"^(.*?)\s*({_REGEX})$", re.DOTALL)


_OCTAL = re.compile(r"0[\d_]")
_ATOM = re.compile(r"\\.|\[(?:[^\]\\]|\\.)*\]|\((?:\?(?:[:=!]|<[=!]|<\w+>|[ims-]+:))?|.", re.DOTALL)


def plausible_regex(literal: str) -> bool:
    """Whether a literal's groups are balanced, nothing but an atom is repeated and its flags are known and different."""
    body, _, flags = literal[1:].rpartition("/")
    if len(set(flags)) != len(flags) or not set(flags) <= set("dgimsuvy"):
        return False
    depth, atom = 0, False
    for m in _ATOM.finditer(body):
        c = m.group()
        if c[0] == "(":
            depth, atom = depth + 1, False
        elif c == ")":
            depth, atom = depth - 1, True
            if depth < 0:
                return False
        elif c in ("*", "+"):
            if not atom:
                return False
            atom = False
        elif c == "?":
            if not atom and body[m.start() - 1 : m.start()] not in ("*", "+", "?", "}"):
                return False
            atom = False
        else:
            atom = c != "|"
    return depth == 0


def misplaced(out: list[str], g: Grammar) -> bool:
    """Whether a ``return`` stands outside all functions, or a ``break`` or ``continue`` where no loop, switch or label came before in its function."""
    c = g.chars
    wanted = {c["return"], c["break"], c["continue"]}
    if not wanted.intersection(out):
        return False
    control = {c[w] for w in ("if", "for", "while", "switch", "catch", "with")}
    loops = {c[w] for w in ("for", "while", "do")}
    names = {c["."], c["?."]}
    opened: list[int] = []
    scopes: list[list[bool]] = [[False, False, False]]  # function, loop met, switch or label met
    kinds: list[bool] = []
    head: dict[int, int] = {}
    for n, t in enumerate(out):
        before = out[n - 1] if n else ""
        if t == "(":
            opened.append(n)
        elif t == ")":
            if opened:
                head[n] = opened.pop()
        elif t == "{":
            body = before == c["=>"]
            if before == ")" and n - 1 in head:
                at = head[n - 1] - 1
                lead = out[at] if at >= 0 else ""
                body = not (lead in control and not (at and out[at - 1] in names)) and not (lead == c["await"] and at and out[at - 1] == c["for"])
            kinds.append(body)
            if body:
                scopes.append([True, False, False])
        elif t == "}":
            if kinds and kinds.pop():
                scopes.pop()
        elif t in loops:
            scopes[-1][1] = True
        elif t == c["switch"] or t == c[":"]:
            scopes[-1][2] = True
        elif t in wanted and before not in names:
            after = out[n + 1] if n + 1 < len(out) else ""
            if after == c[":"] or after == c["="] or after == c[","] or after == "(" and (t != c["return"] or before in (c[","], c["async"], c["*"], c["get"], c["set"], c["static"])):
                continue  # a key
            if t == c["return"]:
                if not any(x[0] for x in scopes) and not (after == "(" and before in ("{", "}", "Z", c[";"])):
                    return True
            elif not scopes[-1][1] and not (t == c["break"] and scopes[-1][2]):
                return True
    return False


def tokens(text: str, g: Grammar) -> list[str] | None:
    """Token characters; ``Z`` where a line end may end a statement. None where a token is unknown."""
    if text.startswith("#!"):
        text = text.partition("\n")[2]
    out: list[str] = []
    fresh = False
    chars = g.chars
    for m in _TOKEN.finditer(text):
        kind = m.lastgroup
        if kind == "skip":
            continue
        if kind == "newline" or kind == "block":
            fresh = fresh or kind == "newline" or "\n" in m.group()
            continue
        if kind == "bad":
            return None
        s = m.group()
        if kind == "regex":
            lead, literal = _PARTS.match(s).groups()
            if not plausible_regex(literal):
                return None
            first = [chars.get(lead, lead)]
            add = [*first, "r"]
        elif kind == "word":
            add = [chars.get(s) or ("h" if s[0] == "#" else "i")]
        elif kind == "number":
            if _OCTAL.match(s):
                return None
            add = ["n"]
        elif kind == "string":
            add = ["s"]
        elif kind == "template":
            add = ["t"]
        else:
            add = [s if s in "(){}[]" else chars[s]]
        if fresh and out and out[-1] in g.may_end and add[0] in g.may_start:
            out.append("Z")
        fresh = False
        out += add
    return out


def _build(ts: bool) -> Grammar:
    g = Grammar({"(": ["PA", "PF", "PH", "PT"], "[": ["KA", "KT"], "{": ["BB", "BO", "BC", "BS", "BW", "BT", "BE"]}, _WORDS, _SIGNS)
    g.cls("ID", " ".join(w for w in _CONTEXTUAL.split() if ts or w not in _STRICT), "i")
    g.cls("NAME", _WORDS, "i")
    g.cls("BINOP", _BINARY)
    g.cls("ASSIGN", _ASSIGN)
    g.cls("UNARY", "! ~ + - ++ -- typeof void delete await new")
    g.rule("L", "Λ?")
    g.rule("END", "(?:(?:';'|Z)+|$)")
    g.rule("KEY", "%NAME|s|n|%KA|h")
    if ts:
        g.rule("TPRIM", "'typeof'?'import'%PA(?:'.'%NAME)*%L|'typeof'?%NAME(?:'.'%NAME)*%L|s|n|'-'n|t|%BT|%KT|%PT")
        g.rule("TUN", "(?:(?:'abstract'?'new')?%L%PF'=>'|'keyof'|'readonly'|'unique'|'infer'|'asserts')*")
        g.rule("TONE", "%TUN%TPRIM%KT*")
        g.rule("TALT", "['|''&']?%TONE(?:['|''&']%TONE)*".replace("['|''&']", "(?:'|'|'&')"))
        g.rule("T", "%TALT(?:'is'%TALT)?(?:'extends'%TALT'?'%TALT':'%TALT(?:'extends'%TALT'?'%TALT':'%TALT)*)?")
        g.rule("ANN", "(?:':'%T)?")
        g.rule("OPT", "'?'?")
        g.cls("MOD", "static private public protected readonly abstract override declare accessor async")
        g.rule("CAST", "(?:'as'|'satisfies')(?:'const'|%T)|'!'|Λ(?=%PA|t)")
        g.rule("DECO", "(?:'@'%ID(?:'.'%NAME)*%PA?Z?)*")
        arg = "(?:'const'|'in'|'out')?".replace("'out'", "i")
        item = f"{arg}%T(?:'extends'%T)?(?:'='%T)?"
        g.reduce = g.compile(g.expand(f"(?<=[{g.rules['ID'][1:-1]}])'<'{item}(?:','{item})*','?'>'(?![ins])|(?<![{g.rules['ID'][1:-1]}ns])'<'{item}(?:','{item})*','?'>'(?=%PF)|(?<![{g.rules['ID'][1:-1]}ns{_CLOSED}])'<'%T'>'(?=%ID|[nst]|'this'|'new'|%KA|%BO)"))
    else:
        for name in ("T", "BT_"):
            g.rule(name, "(?!)")
        for name in ("ANN", "OPT", "DECO"):
            g.rule(name, "")
        g.cls("MOD", "static async")
        g.rule("CAST", "(?!)")
    g.rule("BIND", "%ID|%BO|%KA")
    g.rule("FUNC", "'async'?'function''*'?%ID?%L%PF%ANN%BB")
    g.rule("HERIT", "(?:'extends'(?:%ID|'this'|%PA|'null')(?:'.'%NAME|%PA|Λ)*)?" + ("(?:'implements'%TALT(?:','%TALT)*)?" if ts else ""))
    g.rule("CLASSX", "'class'%ID?%L%HERIT%BC")
    g.rule("ARROW", "'async'?(?:%ID|%L%PF%ANN)'=>'")
    g.rule("PRE", "(?>%UNARY" + ("|Λ" if ts else "") + ")")
    g.rule("PRIM", "%FUNC|%CLASSX|%ID|'this'|'super'|'null'|'true'|'false'|n|s|t|r|%PA|%KA|%BO|h(?='in')|'import'(?:'.'%NAME|%PA)|'new''.'%NAME|(?<='=>')%BB")
    g.rule("MEMBER", "'.'(?:%NAME|h)|%KA")
    g.rule("POST", "'.'(?:%NAME|h)|'?.'(?:%NAME|h|%PA|%KA)|%KA|%PA|t|'++'|'--'|%CAST")
    g.rule("OP", "%BINOP|'>''='?|'>''>''>'?")
    g.rule("OPERAND", "(?>%PRE*)%PRIM(?>%POST*)")
    # what may be assigned to: a name, a pattern, a member that no optional link leads to, or one of these in parentheses
    links = "'.'(?:%NAME|h)|%KA|%PA|t" + ("|%CAST" if ts else "")
    g.rule("TARGET", f"(?:%FUNC|%CLASSX|%ID|'this'|'super'|'null'|n|s|t|r|%PA|%KA|%BO|'import''.'%NAME|'new'%PRIM)(?:{links})*?%MEMBER|%ID{"(?:%CAST)*" if ts else ""}|%BO|%KA|%PA" + ("|Λ%PRIM" if ts else ""))
    g.rule("LEAD", "(?>(?:%ARROW|'yield''*'?(?!','|';'|':'|Z|$)|%TARGET(?:%ASSIGN|'>''>''>'?'='))*)")
    g.rule("B", "(?>%OPERAND(?>(?:%OP)%OPERAND)*|'yield')")
    g.rule("E", "(?>%LEAD%B(?>'?'%LEAD%B(?:'?'%LEAD%B':'%LEAD%B)?':'%LEAD%B)*)")
    g.rule("XE", "%E(?:','%E)*")
    # contents of pairs
    g.rule("inPA", "(?:(?:'...')?%E(?:','(?:'...')?%E)*','?)?")
    param = "%DECO(?:%MOD)*(?:'...')?(?:%BIND|'this')%OPT%ANN(?:'='%E)?"
    g.rule("inPF", f"(?:{param}(?:','{param})*','?)?")
    g.rule("inPT", "%T" if ts else "(?!)")
    decl = "%BIND" + ("(?:'!')?" if ts else "") + "%ANN(?:'='%E)?"
    if ts:
        g.rule("DECLS", f"(?:'var'|'let'|'const'){decl}(?:','{decl})*")
    else:  # constants and patterns have a value
        valued = "%BIND'='%E"
        loose = f"(?:%ID(?:'='%E)?|{valued})"
        g.rule("DECLS", f"(?:'var'|'let'){loose}(?:','{loose})*|'const'{valued}(?:','{valued})*")
    g.rule("inPH", "(?:'var'|'let'|'const')%BIND%ANN(?:'of'%E|'in'%XE)|%OPERAND(?:'of'%E|'in'%XE)|(?:%DECLS|%XE)?';'%XE?';'%XE?")
    g.rule("inKA", "(?:','*(?:'...')?%E(?:','+(?:'...')?%E)*)?','*")
    if ts:
        elem = "(?:'...')?(?:%ID'?'?':')?%T'?'?"
        g.rule("inKT", f"(?:{elem}(?:','{elem})*','?)?|%ID'in'%T(?:'as'%T)?")
        sep = "(?:';'|','|Z)"
        sig = "(?:'-'|'+')?'readonly'?(?:(?:'get'|'set')?%KEY(?:'?')?(?:%L%PF%ANN|%ANN)|'new'?%L%PF%ANN|%KT(?:(?:'-'|'+')?'?')?%ANN)"
        g.rule("inBT", f"{sep}*(?:{sig}(?:{sep}+{sig})*{sep}*)?")
    else:
        g.rule("inKT", "(?!)")
        g.rule("inBT", "(?!)")
    method = "(?:'get'|'set'|'async'?'*'?)%KEY%OPT%L%PF%ANN%BB"
    prop = f"(?:'...'%E|{method}|%KEY':'%E|%ID(?:'='%E)?)"
    g.rule("inBO", f"(?:{prop}(?:','{prop})*','?)?")
    spec = "(?:'type')?(?:%NAME|s)(?:'as'(?:%NAME|s))?" if ts else "(?:%NAME|s)(?:'as'(?:%NAME|s))?"
    g.rule("inBS", f"(?:{spec}(?:','{spec})*','?)?")
    member = f"(?:';'|Z|'static'%BB|%DECO%MOD*(?:'get'|'set'|'*')?%KEY(?:'?'|'!')?%L%PF%ANN(?:%BB{'|%END' if ts else ''})|%DECO%MOD*%KEY{"(?:'?'|'!')?" if ts else ''}%ANN(?:'='%E)?%END{'|%MOD*%KT%ANN%END' if ts else ''})"
    member = member.replace("(?:'?'|'!')?%L%PF", ("(?:'?'|'!')?" if ts else "") + "%L%PF")
    g.rule("inBC", f"(?:{member})*")
    g.rule("inBE", "(?:%KEY(?:'='%E)?(?:','%KEY(?:'='%E)?)*','?)?" if ts else "(?!)")
    fn = "'async'?'function''*'?%ID%L%PF%ANN(?:%BB" + ("|%END" if ts else "") + ")"
    cls = "%DECO" + ("'abstract'?" if ts else "") + "'class'%ID%L%HERIT%BC"
    typed = "|'type'%ID%L'='%T%END|'interface'%ID%L(?:'extends'%TALT(?:','%TALT)*)?%BT|'const'?'enum'%ID%BE|(?:'namespace'|'module'|'global')(?:%ID(?:'.'%ID)*|s)?%BB" if ts else ""
    g.rule("DECLARED", f"(?:{fn}|{cls}|%DECLS%END{typed})")
    head = "(?:'for''await'?%PHZ?|'while'%PAZ?|%ID':'(?!':'))"
    simple = (
        "(?:';'|Z|%BB|%DECLARED|'return'%XE?%END|'throw'%XE%END|(?:'break'|'continue')%ID?%END|'debugger'%END"
        "|'try'%BBZ?(?:'catch'%PF?%BBZ?'finally'%BB|'catch'%PF?%BB|'finally'%BB)|'switch'%PA%BW|(?!'function'|'class'|%BO)%XE%END)"
    ).replace("%PAZ", "%PA Z").replace("%BBZ", "%BB Z")
    head = head.replace("%PAZ", "%PA Z").replace("%PHZ", "%PH Z")
    if ts:
        simple = simple.replace("%DECLARED", "'declare'?%DECLARED")
    # the statement of an if may have an else; no else stands alone
    g.defined["STMT"] = "(?!)"
    g.rules["STMT"] = "(?&STMT)"
    g.defined["STMT"] = g.expand(f"(?>(?:{head})*(?:'if'%PA Z?(?&STMT)(?:Z*'else'Z?(?&STMT))?|'do'Z?(?&STMT)Z*'while'%PA(?:';'|Z)?|{simple}))")
    clause = "(?:%ID|(?:%ID',')?(?:%BS|'*''as'%ID))"
    kind = "(?:'type')?" if ts else ""
    tail = "(?:'with'%BO)?%END"
    module = (
        f"'import'(?:s|{kind}{clause}'from's){tail}|'export'(?:{'(?:' + chr(39) + 'declare' + chr(39) + ')?' if ts else ''}%DECLARED|'default'(?:'async'?'function''*'?%ID?%L%PF%ANN%BB|{'(?:' + chr(39) + 'abstract' + chr(39) + ')?' if ts else ''}%DECO'class'%ID?%L%HERIT%BC|%E%END)"
        f"|{kind}%BS(?:'from's(?:'with'%BO)?)?%END|{kind}'*'(?:'as'%NAME)?'from's{tail})"
        + ("|'import'%ID'='%E%END|'export''='%E%END" if ts else "")
    )
    g.rule("MODULE", f"(?:%STMT|{module})*")
    g.rule("inBB", "%MODULE" if ts else "%STMT*")
    g.rule("inBW", "(?:(?:'case'%XE|'default')':'%STMT*|Z)*")
    g.finish("MODULE")
    for name in ("BB", "BC", ""):
        g.repeats(name, "; Z")
    words = {g.chars[w] for w in g.words}
    no_end = {g.chars[w] for w in ("" if ts else "void ").split()} | {g.chars[w] for w in "function class extends if else for while do switch case default try finally throw new delete typeof in instanceof var const import export with".split()}
    no_start = {g.chars[w] for w in "in instanceof of as satisfies extends implements catch finally is from".split()}
    g.may_end = set(")]}insthrΛ") | (words - no_end) | {g.chars["++"], g.chars["--"], g.chars["!"]} if ts else set(")]}insthr") | (words - no_end) | {g.chars["++"], g.chars["--"]}
    g.may_start = set("insh{") | (words - no_start) | {g.chars[s] for s in "! ~ ++ -- @".split()} | (set("[*") & set("["))
    return g


JAVASCRIPT, TYPESCRIPT = _build(False), _build(True)


def parses(text: str, ts: bool) -> bool:
    """Whether a text is a JavaScript module, or TypeScript."""
    g = TYPESCRIPT if ts else JAVASCRIPT
    t = tokens(text, g)
    return t is not None and (ts or not misplaced(t, g)) and g.accepts(t)
