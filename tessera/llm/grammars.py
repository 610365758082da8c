"""Grammars of the checked languages, as statement productions over class symbols.

Classes shared by all: i name, n number or constant, s string, o binary operator, p operator that is binary or
prefix, u prefix operator, x increment, e assignment, a arrow, D spread or range prefix, P B C the
groups in (), [] and {}; punctuation stands for itself. Upper-case and other letters are keywords, see each lexer.
A production is a regular expression over these; nesting is handled by the groups, whose content has a context of its own.
"""

from __future__ import annotations

import re

from tessera.llm.lexing import Lexer

def numbers(suffix: str, radix_suffix: str, hex_float: str = "") -> list[tuple[str, str]]:
    """Patterns of numbers with the suffixes a language has; a number that runs on into a word can't be read."""
    whole = r"0[bB][01_]+|0[oO][0-7_]+"
    decimal = r"(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+\-]?\d[\d_]*)?"
    return [(rf"(?:{hex_float}(?:0[xX][\da-fA-F_]+|{whole}){radix_suffix}|{decimal}{suffix})(?![\w$])", "n"), (r"\d[\w$]*", "\x00")]


HEX_FLOAT = r"0[xX][\da-fA-F_]*\.?[\da-fA-F_]*[pP][+\-]?\d[\d_]*[fFdDi]?|"
WORD = r"[^\W\d]\w*"
COMMENTS = [(r"//[^\n]*", "comment"), (r"/\*[\s\S]*?\*/", "comment"), (r"/\*", "\x00")]


def keys(**classes: str) -> dict[str, str]:
    """Keyword classes from symbol = "words"; a trailing underscore keeps a symbol apart from a Python keyword."""
    return {w: k.rstrip("_") for k, words in classes.items() for w in words.split()}


# JavaScript and TypeScript
SCRIPT_WORDS = keys(
    n="true false null this super undefined", c="const", v="var let", F="function", K="class", W="new", u="typeof delete await", V="void", U="yield", I="if", L="else", f="for", w="while", d="do", t="try", h="catch", z="finally",
    R="return", T="throw", S="switch", b="break continue debugger", M="import", X="export", Z="case default", G="extends implements", o="in instanceof", q="of", m="from", k="as satisfies with", y="async",
    A="enum", H="interface",
    j="namespace module declare global abstract type static readonly public private protected get set override accessor asserts keyof infer unique is out using",
)


def script(typed: bool) -> Lexer:
    return Lexer(
        [
            *COMMENTS,
            (r"\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*'", "s"),
            *numbers("n?", "n?"),
            (r"new\.target(?![$\w])", "n"),
            (r"[#$\w][$\w]*", "word"),
            (r"\.\.\.", "D"),
            (r"=>", "a"),
            (r"\+\+|--", "x"),
            (r"\*\*=|<<=|>>>=|>>=|&&=|\|\|=|\?\?=|[+\-*/%&|^]=", "e"),
            (r"===|!==|==|!=|<=|>=|&&|\|\||\?\?|<<|>>>|>>|\*\*", "o"),
            (r"\?\.(?!\d)", "."),
            (r"=", "e"),
            (r"[+\-]", "p"),
            (r"[*/%<>&|^]", "o"),
            (r"!", "!"),
            (r"~", "u"),
            (r"[.,;:?]", "self"),
            (r"@[A-Za-z_$][\w$]*(?:\.[\w$]+)*|@(?=\()", "@"),
            (r"[()\[\]{}]", "bracket"),
        ],
        SCRIPT_WORDS,
        ends="insExb)]}RqmkyjUV" + ("!" if typed else ""),
        starts="insExFKWuVUIfwdtRTSbMXZcvyjqm!@AH",
        newline=True,
        angles="ts" if typed else "",
        regexes=True,
        markup=True,
        after={("k", "c"): "i"},
    )


SCRIPT_NAME = "[iqmkyj]"


def script_productions(typed: bool) -> dict[str, str]:
    name, key = SCRIPT_NAME, "(?:[insBxcvFKWuVUILfwdthzRTSbMXZGoqmkyjAH])"  # any word is a key
    # types
    atom = rf"(?:{name}|[nsEPBCV]|MP)(?:\.i|B)*"
    plain = rf"(?:[ujcpW]|[in]j(?=[iqmkyjnsEPBCuWV])|Pa)*{atom}"
    type_ = rf"(?:o?{plain}(?:o{plain})*(?:G{plain}(?:[oG?:]o?{plain})*)?)"
    note = rf"(?:[!?]?:{type_}|[!?])?" if typed else ""
    back = rf"(?::{type_})?" if typed else ""
    deco = r"(?:@P?;?)*"
    # expressions
    fn = rf"y?Fo?{name}?P{back}C"
    heirs = rf"(?:G(?:{name}|[nP])(?:\.i|P|B)*(?:,{name}(?:\.i)*)*)*"
    cl = rf"{deco}K{name}?{heirs}C"
    bang = "!" if typed else ""
    post = rf"(?:\.[iPBE]|[PBEx{bang}])*"
    place = rf"(?:(?:{name}|[BCP])|(?:{name}|[inPBCsE]|M)(?:\.[iPBE]|[PBE{bang}])*(?:\.i|B|!))"
    prefix = rf"(?:[u!pxWV]|Uo?|{place}e|y?(?:{name}|P{back})a)*"
    operand = rf"{prefix}(?:{fn}|{cl}|[insEPBCU]|{name}|M(?=[P.])){post}" + (rf"(?:k{type_})*" if typed else "")
    chain = rf"(?:(?:[op]|\?(?=[^;]*:)(?:{operand}[op?:])+){operand})*"
    expr = rf"(?:{operand}{chain})"
    many = rf"(?:{expr}(?:,{expr})*)"
    target = rf"(?:{name}|[BC])"
    first = rf"{target}{note}e{expr}"
    var = rf"(?:(?:c|u?j(?={name})){first}(?:,{first})*|v{target}{note}(?:e{expr})?(?:,{target}{note}(?:e{expr})?)*)"
    # statements
    attempt = r"tC(?:;?hP?;?C(?:;?zC)?|;?zC)"
    declared = rf"(?:y?Fo?{name}P{back}C|{deco}j*K{name}{heirs}C" + (rf"|[jc]*[jAH](?:{name}|s)(?:\.i)*{heirs}C|jjC" if typed else "") + ")"
    typings = rf"|j*j{name}e{type_}|j*y?Fo?{name}P{back}|j+(?:{var}|[cv]{target}{note}(?:,{target}{note})*)|M{name}e{expr}|j+s" if typed else ""
    mark = "j?" if typed else ""
    names = rf"(?:(?:{mark}(?:{name}|Z|s)(?:k(?:{name}|Z|s))?)(?:,{mark}(?:{name}|Z|s)(?:k(?:{name}|Z|s))?)*,?)?"
    clause_ = rf"(?:{name}|C|ok{name})"
    import_ = rf"M(?:j?{clause_}(?:,{clause_})*;?ms|s)(?:kC)?"
    simple = rf"(?:{var}|R(?:{many})?|T{many}|b{name}?|(?!y?F|K){many}|{import_}|fu?P|wP|IP{typings})"
    loop_ = rf"d(?:C|{simple};);?wP"
    block = rf"(?:C|{declared}|{attempt}|SPC|{loop_})"
    out = rf"X(?:Z(?:y?Fo?{name}?P{back}C|{deco}j*K{name}?{heirs}C)|{declared})"
    sent = rf"X(?:C(?:ms(?:kC)?)?|o(?:k(?:{name}|s|Z))?ms|Z{expr}|{simple}" + (rf"|jC(?:ms)?|jo(?:k{name})?ms|e{expr}|k{name}{name}|Z{deco}j*y?Fo?{name}?P{back}|ZH{name}{heirs}C" if typed else "") + ")"
    lead = rf"(?:IP;?|(?<=[C;])L|fu?P;?|wP;?|{name}:(?!:))*"
    # a statement once read stays read: no way back over a long text that ends badly
    statement = rf"{lead}(?:{block}|{deco}{out})|{lead}(?:{simple}|{sent})(?:;|$)"
    lines = rf"(?>;|{statement})*+"
    clauses = rf"(?=;*(?:Z|$))(?>;|Z(?:{many})?:|{statement})*+"
    entry = rf"(?:D{expr}|[jy]?o?{key}P{back}C|{key}:{expr}|{name}(?:e{expr})?|E:{expr})"
    table = rf"(?:{entry}(?:,|$))*"
    kinds = r"(?:p?j|c|y)*"
    last = r"(?:;|,|$|(?=B))" if typed else r"(?:;|$)"
    member = rf"{deco}(?:[jyo]*{key}[!?]?P{back}(?:C|;|,|$)|{kinds}{key}(?:p?[!?])*{back}(?:e{expr})?{last}|W?P{back}(?:;|,|$)|jC)" if typed else rf"{deco}(?:[jyo]*{key}P(?:C|;)|[jy]*{key}(?:e{expr})?{last}|jC)"
    body = rf"(?>;|{member})*+"
    signatures = rf"(?>;|[jyo]*{key}[!?]?P{back}(?:;|,|$)|{kinds}{key}(?:p?[!?])*{back}{last}|W?P{back}(?:;|,|$))*+"
    arg = rf"(?:{deco}j*(?:D?(?:{target}|n){note}(?:e{expr})?|D?{expr}))"
    args = rf"(?:{arg}(?:,|$))*"
    item = rf"D?(?:{name}\??:)?{type_}\??"
    loop = rf"(?:(?:{var}|{many})?;+(?:{many})?;+(?:{many})?|(?:[cv]|u?j)?(?:{target}{note}|{place})(?:q|o){many})"
    elements = rf",*(?:D?{expr}(?:,+|$))*"
    typed_list = rf"|(?:{item}(?:,|$))*|{name}:{type_}|{name}o{type_}(?:k{type_})?"
    either = rf"(?:{table}|{body})" if typed else table
    return {
        "file": lines, "block": lines, "switch": clauses, "object": either, "class": body, "interface": signatures, "names": names, "cond": many, "loop": loop, "catch": rf"{target}{note}",
        "(": rf"(?:{args}" + (rf"|{type_})" if typed else ")"), "[": rf"(?:{elements}" + (typed_list if typed else "") + ")", "{": rf"(?:{lines}|{table}|{body}|{names})",
    }


SCRIPT_CLASS = re.compile(rf"K{SCRIPT_NAME}?(?:G(?:[^;:?ea{{]*))?$")
SCRIPT_TYPED = re.compile(rf"^X?Z?[jc]*(?P<kind>[jAH])(?:{SCRIPT_NAME}|s)(?:\.i)*(?:G[^e]*)?$|^X?jj$")


def script_context(outer: str, before: str, bracket: str) -> str:
    if bracket == "(":
        if outer not in ("class", "object") and re.search(r"(?:^|[^.])(?:[Iw]|S)$", before):
            return "cond"
        if outer not in ("class", "object") and re.search(r"f(?:u)?$", before):
            return "loop"
        return "catch" if before.endswith("h") and outer not in ("class", "object") else bracket
    if bracket == "[":
        return bracket
    part = re.split(r"[;C]", before)[-1] if not before.endswith("C") else ""
    if re.match(rf"^[MX]j?(?:{SCRIPT_NAME},)?$", part):
        return "names"
    if SCRIPT_CLASS.search(part):
        return "class"
    if outer not in ("class", "object") and (typed := SCRIPT_TYPED.match(part)):
        return {"A": "object", "H": "interface"}.get(typed["kind"], "{")
    if part.endswith("SP") and outer not in ("class", "object"):
        return "switch"
    if outer == "class" and part.endswith("j"):
        return "block"
    if not part:
        return "block" if outer in ("file", "block", "switch") else "object" if outer in ("(", "[", "cond") else "{"
    if part[-1] == "a":
        return "{" if re.search(r":[^?e]*Pa$|^[Xj]*j[iqmkyj]e", part) else "block"
    if part[-1] in "PLtzdh" or re.search(r"P:[^e,?:;]*[insEPBqmkyjuV]$", part):
        return "block"
    if part[-1] == ":" and outer != "{":
        return "block" if outer in ("file", "block", "switch") and re.match(r"^(?:Z[^?]*|[iqmkyj]):$", part) else "object"
    if part[-1] in "eope,RTDuVW?(cvk" or re.search(r"XZ$", part):
        return "object"
    return "{"


# Go
GO = Lexer(
    [
        *COMMENTS,
        (r"`[^`]*`", "s"),
        (r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\[^\n]+?|[^'\\\n])'", "s"),
        *numbers("i?", "i?", HEX_FLOAT),
        (WORD, "word"),
        (r"\.\.\.", "D"),
        (r"\+\+|--", "x"),
        (r"<-", "u"),
        (r":=|<<=|>>=|&\^=|[+\-*/%&|^]=", "e"),
        (r"==|!=|<=|>=|&&|\|\||<<|>>|&\^", "o"),
        (r"=", "e"),
        (r"[+\-*&^]", "p"),
        (r"[/%<>|]", "o"),
        (r"[!~]", "u"),
        (r"[.,;:]", "self"),
        (r"[()\[\]{}]", "bracket"),
    ],
    keys(k="package", M="import", F="func", v="var const", j="type", I="if", L="else", f="for", r="range", S="switch select", Z="case default", R="return", g="defer go", b="break continue goto fallthrough", T="struct", N="interface", m="map", h="chan"),
    ends="insxb)]}R",
    starts=None,
    newline=True,
)


# parts of Go that its productions and its contexts share
GO_TYPE = r"(?:(?:[BphDu]|mB|FP)*(?:i(?:\.i)?B?|[TN]C|FP|P))"
GO_BACK = rf"(?:P|{GO_TYPE})?"


def go_productions() -> dict[str, str]:
    type_, back = GO_TYPE, GO_BACK
    operand = rf"(?:[pu]*(?:FP{back}C|(?:[BpD]|mB)*(?:[ins]|[TN]C)(?:\.i)*C?|B(?:[Bp]|mB)*FP{back}C|P)(?:\.[iP]|P|B|C)*D?)"
    expr = rf"(?:{operand}(?:[op]{operand})*)"
    many = rf"(?:{expr}(?:,{expr})*)"
    simple = rf"(?:{many}(?:e{many}|x|u{expr})?)"
    head = rf"(?:(?:{simple})?;)?"
    if_ = rf"I{head}{simple}C(?:LI{head}{simple}C)*(?:LC)?"
    for_ = rf"f(?:(?:{simple})?;(?:{expr})?;(?:{simple})?|(?:{many}e)?r{expr}|{expr})?C"
    decl = rf"(?:v(?:P|i(?:,i)*(?:{type_}(?:e{many})?|e{many}))|j(?:P|iB?e?{type_}))"
    statement = rf"(?:i:;?)*(?:{if_}|{for_}|S(?:{head}(?:{simple})?)C|C|{decl}|R(?:{many})?|g{expr}|bi?|{simple})|i:"
    lines = rf"(?>;|(?:{statement})(?:;|$))*+"
    clauses = rf"(?=;*(?:Z|$))(?>;|Z(?:{many}|{simple}|{type_}(?:,{type_})*)?:|(?:{statement})(?:;|(?=Z)|$))*+"
    top = rf";*ki(?:;+M(?:s|P|[i.]s))*(?:;+(?:FP?iB?P{back}C?|{decl}))*;*"
    arg = rf"(?:{type_}|{expr}|i{type_})"
    entry = rf"(?:(?:{expr}|C)(?::(?:{expr}|C))?)"
    table = rf"(?:{entry}(?:,{entry})*,?;*)?"
    field = rf"(?:i(?:,i)*{type_}s?|p?i(?:\.i)?B?s?)"
    fields = rf"(?>;|{field}(?:;|$))*+"
    union = rf"u?{type_}(?:ou?{type_})*"
    methods = rf"(?>;|(?:iP{back}|{union})(?:;|$))*+"
    group = r"(?:;|[i.]?s(?:;|$))*"
    decls = rf"(?>;|i(?:,i)*(?:{type_})?(?:e{many})?(?:;|$)|iB?e?{type_}(?:;|$))*+"
    params = rf"(?:i(?:,;*i)*{union}(?:,;*i(?:,;*i)*{union})*,?;*)"
    return {"file": top, "(": rf"(?:;*(?:{arg}(?:,;*{arg})*,?;*)?|{group}|{decls}|j)", "[": rf"(?:D|{type_}(?:,;*{type_})*,?|{expr}|{params}|(?:{expr})?:(?:{expr})?(?::{expr})?)?;*", "block": lines, "switch": clauses, "literal": table, "struct": fields, "interface": methods}


GO_HEAD = re.compile(r"[IfS](?=[^IfS]*$)")
GO_LITERALS = re.compile(rf"FP{GO_BACK}C|(?:B|mB)[Bp]*i(?:\.i)?C|[TN]C+")


def go_context(outer: str, before: str, bracket: str) -> str:
    if bracket != "{":
        return bracket
    if before.endswith(("T", "N")):
        return "struct" if before[-1] == "T" else "interface"
    if re.search(rf"B[Bp]*FP{GO_BACK}$", before):
        return "literal"
    if re.search(rf"F(?:P?iB?)?P{GO_BACK}$", before):
        return "block"
    if re.search(r"B[Bp]*i(?:\.i)?$|[TN]C$", before):
        return "literal"
    # the body of the last if, for or switch, unless that has had one
    head = GO_HEAD.search(before)
    if head and outer in ("block", "switch") and "C" not in GO_LITERALS.sub("", before[head.end() :]):
        return "switch" if head[0] == "S" else "block"
    if outer in ("block", "switch", "file") and (not before or before[-1] in ";:LC"):
        return "block"
    return "literal"


# Rust
RUST = Lexer(
    [
        *COMMENTS,
        (r"[bc]?r(?P<h>#*)\"[\s\S]*?\"(?P=h)", "s"),
        (r"[bc]?\"(?:\\[\s\S]|[^\"\\])*\"", "s"),
        (r"b?'(?:\\(?:[^u]|u\{[0-9a-fA-F]+\})[0-9a-fA-F]*|[^'\\\n])'", "s"),
        (r"'[^\W\d]\w*", "'"),
        (r"(?:0x[\da-fA-F_]+?|0o[0-7_]+|0b[01_]+|\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?(?:[eE][+\-]?[\d_]+)?)_?(?:[iu](?:8|16|32|64|128|size)|f32|f64)?(?!\w)", "n"),
        (r"\d\w*", "\x00"),
        (r"r#[^\W\d]\w*", "i"),
        (r"union(?=\s+[^\W\d]\w*\s*[<{])", "K"),
        (WORD, "word"),
        (r"::", "."),
        (r"->", "a"),
        (r"=>", "A"),
        (r"\.\.=|\.\.\.|\.\.", "D"),
        (r"<<=|>>=|[+\-*/%&|^]=", "e"),
        (r"\|\|", "Q"),
        (r"==|!=|<=|>=|&&|<<|>>", "o"),
        (r"=", "e"),
        (r"[\-*&]", "p"),
        (r"\|", "O"),
        (r"[+/%<>^]", "o"),
        (r"!", "!"),
        (r"#(?=!?\[)", "#"),
        (r"[.,;:?@$]", "self"),
        (r"[()\[\]{}]", "bracket"),
    ],
    keys(U="use", V="pub", v="unsafe extern", F="fn", K="struct", E="enum", X="trait", J="impl", N="mod", c="const static", j="type", l="let", m="mut ref", M="match", I="if", L="else", w="while loop", f="for", q="in", R="return break continue", k="as", W="where", n="true false", z="async move", d="dyn"),
    angles="rust",
)
# The macros whose arguments are expressions; what others take is up to them.
RUST_MACROS = "print println eprint eprintln format panic write writeln vec assert assert_eq assert_ne debug_assert todo unimplemented unreachable dbg trace debug info warn error".split()


def rust_productions() -> dict[str, str]:
    path = r"(?:i(?:\.[iP])*P?)"
    plain = rf"(?:[pmdJ']|cm?)*(?:{path}|P|B|!|[vz]*s?FP)"  # a type without what it gives back
    bound = rf"(?:'|\??{plain}(?:a{plain})*)"
    type_ = rf"(?:{bound}(?:o{bound})*)"
    bounds = rf"(?::(?:{bound}(?:o|(?=[WC;e,])|$))*)?"
    where = rf"(?:W(?:{bound}(?:[:o,]+|(?=[C;e])|$))*)?"
    macro = r"(?:i(?:\.i)*![PBC])"
    single = r"(?:[pm]*(?:i(?:\.i)*|n|s|pn)?(?:(?<=[isn])D(?:=?p?[isn](?:\.i)*)?|Dp?[isn]?|(?<=i)[PC]|(?<=i)!P|(?<![isn])[PB])?(?:@(?:p?[isn](?:\.i)*(?:D(?:p?[isn])?)?|P))?)"
    sub = rf"(?:(?=[pmisnPBD]){single})"
    pattern = rf"(?:O?(?:{sub}(?:O|(?![pmisnPBDO])))+)"
    closure = rf"(?:z*(?:O(?:(?:#B)*{sub}(?::{type_})?(?:,|(?=O)))*O|Q)(?:a{type_})?)"
    post = rf"(?:\.(?:i|n)|P|B|\?|k{type_}|\.P)*"
    operand0 = rf"(?:[p!mDz]*(?:{closure})?[p!m]*(?:{macro}|i(?:\.i)*C?|n|s|P|B|C|R'?){post})"
    infix = r"[opOQeD]"
    condition = rf"(?:(?:l{pattern}e)?{operand0}(?:[opOQD][p!OD]*|(?=[CA])))+D?"
    control = rf"(?:#B)*(?:(?:I{condition}CL?)+C?(?<=C)|(?:M|(?:':)?(?:w|f{pattern}q)){condition}C|(?:':)?wC|[vzc]*(?:':)?C)"
    operand = rf"(?:(?:[p!mDz]|R'?)*(?:{closure})?(?:[p!m]|R'?)*(?:{control}|{macro}|i(?:\.i)*C?|n|s|P|B|C|R'?|(?<=D)(?=[,;]|$)){post}D?)"
    expr = rf"(?:{operand}(?:{infix}{operand})*)"
    attributes = r"(?:#!?B)*"
    seen = r"(?:VP?)?"
    fn = rf"[vczs]*FiP(?:a{type_})?{where}"
    use = r"U(?:i|\.|C|p|k)+;"
    item = rf"{attributes}{seen}(?:{use}|vii(?:ki)?;|{fn}(?:C|;)|[KE]i{where}(?:C|P?{where};)|v*Xi{bounds}{where}(?:C|e{type_};)|v*J(?:!?{type_}f)?{type_}{where}C|Ni(?:;|C)|cm?i:{type_}(?:e{expr})?;|ji{bounds}{where}(?:e{type_}{where})?;|i!iC|vsC|vC(?![.?]))"
    let = rf"l{pattern}(?::{type_})?(?:e{expr}(?:LC)?)?;"
    lines = rf"(?>;|{item}|(?:#B)*{let}|(?:#B)*{expr}(?:;|$)|{control}|(?:#B)*(?:i(?:\.i)*!C)|R'?;)*+"
    top = rf"(?>#!?B|;|{item}|{macro};?)*+"
    arm = rf"(?:(?:#B)*{pattern}(?:I{condition})?A(?:{expr}(?:,|$)|{control},?|{macro}(?<=C)))"
    member = rf"{attributes}{seen}(?:{fn}(?:C|;)|cm?i:{type_}(?:e{expr})?;|ji{bounds}{where}(?:e{type_}{where})?;)"
    members = rf"(?>#!?B|{member}|{macro};?)*+"
    field = rf"(?:#B)*{seen}i:{type_}"
    variant = rf"(?:#B)*i(?:P|C)?(?:e{expr})?"
    init = rf"(?:(?:#B)*(?:[in](?::{expr})?|D{expr}?|[pm]*i(?::{pattern})?|[in]:{pattern}))"
    names = r"(?:(?:i|C|p|\.|k)+(?:,(?:i|C|p|\.|k)+)*,?)?"
    param = rf"(?:#B)*(?:(?:p'?m?i|m?i|{pattern})(?::{type_})?|{expr}|{seen}{type_}|D)"
    listing = rf"(?:{param}(?:,|$))*"
    return {"file": top, "(": rf"(?:{listing}|i(?:,i)*|q?i(?:\.i)*)", "[": rf"(?:{listing}|{expr};{expr}|{type_};{expr}|i(?:\.i)*(?:e?[sPnBC]|e{expr})?)?", "block": lines, "arms": rf"(?:{arm})*", "fields": rf"(?:{field}(?:,|$))*", "variants": rf"(?:{variant}(?:,|$))*", "literal": rf"(?:{init}(?:,|$))*", "names": names, "items": top, "members": members, "{": rf"(?:{lines}|{arm}*|(?:{field}(?:,|$))*|(?:{init}(?:,|$))*|{names}|{top})"}


RUST_ITEM = re.compile(r"^(?:#!?B)*(?:VP?)?v*(?:(?P<kind>[JNKEXU])|(?:[vczs])*F|s$)")
RUST_KINDS = {"J": "members", "X": "members", "N": "items", "K": "fields", "E": "variants", "U": "names"}


def rust_context(outer: str, before: str, bracket: str) -> str:
    if bracket != "{":
        return bracket
    if outer in ("names", "{"):
        return outer
    if re.search(r"i!i?$", before):
        return "{"  # what a macro takes is up to the macro
    if outer == "variants" and before.endswith("i"):
        return "fields"
    item = RUST_ITEM.match(re.split(r"[;C]", before)[-1])
    if item:
        return RUST_KINDS[item["kind"]] if item["kind"] else "members" if item[0].endswith("s") else "block"
    head = max(before.rfind(c) for c in "IMwf")
    if head >= 0:
        # a head's patterns may hold braces, its conditions none but the body
        rest = before[head + 1 :]
        pattern = re.search(r"^[^q]*$", rest) if before[head] == "f" else re.search(r"l[^e]*$", rest)
        rest = re.sub(r"l[^e]*e", "", rest) if before[head] != "f" else re.sub(r"^[^q]*q", "", rest)
        if pattern and "C" not in re.sub(r"iC", "", pattern[0]) and before.endswith("i"):
            return "literal"
        if not pattern and not re.search(r"[C;A,]", rest):
            return "arms" if before[head] == "M" else "block"
    if re.search(r"[OQ]a[^;,]*$", before) or not before.endswith("i"):
        return "block"
    return "literal"


def without_macros(text: str, tokens: list[tuple[str, int, bool]]) -> list[tuple[str, int, bool]]:
    """Rust's tokens without those inside the brackets of macros that aren't among RUST_MACROS; all
    brackets must have been checked before."""
    out: list[tuple[str, int, bool]] = []
    depth = 0
    for k, token in enumerate(tokens):
        kind = token[0]
        if depth:
            depth += (kind in "([{") - (kind in ")]}")
            if depth:
                continue
        elif kind in ("(", "[", "{") and k > 1:
            bang = k - 1 if tokens[k - 1][0] == "!" else k - 2 if tokens[k - 1][0] == "i" and tokens[k - 2][0] == "!" else 0
            if bang and tokens[bang - 1][0] == "i":
                word = re.match(r"\w+", text[tokens[bang - 1][1] :])
                depth = int(word is None or word[0] not in RUST_MACROS)
        out.append(token)
    return out


# Java
JAVA = Lexer(
    [
        *COMMENTS,
        (r"\"\"\"[\s\S]*?\"\"\"", "s"),
        (r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.|[^'\\\n])'", "s"),
        *numbers("[lLfFdD]?", "[lL]?", HEX_FLOAT),
        (r"@interface\b|record(?=\s+[^\W\d]\w*\s*[<(])", "K"),
        (r"non-sealed\b|sealed(?=\s+(?:(?:public|abstract|static|strictfp)\s+)*(?:class|interface)\b)", "V"),
        (r"permits(?=\s+[\w.$]+(?:\s*,\s*[\w.$]+)*\s*\{)", "G"),
        (r"@(?=\s*[^\W\d])", "@"),
        (r"[$\w][$\w]*", "word"),
        (r"\.\.\.", "D"),
        (r"->", "a"),
        (r"::", "."),
        (r"\+\+|--", "x"),
        (r"<<=|>>>=|>>=|[+\-*/%&|^]=", "e"),
        (r"==|!=|<=|>=|&&|\|\||<<|>>>|>>", "o"),
        (r"=", "e"),
        (r"[+\-]", "p"),
        (r"[*/%<>&|^]", "o"),
        (r"[!~]", "u"),
        (r"[.,;:?]", "self"),
        (r"[()\[\]{}]", "bracket"),
    ],
    keys(k="package", M="import", V="public private protected static abstract native transient volatile strictfp", v="final", y="synchronized", K="class interface", E="enum", G="extends implements throws", W="new", I="if", L="else", f="for", w="while", d="do", t="try", h="catch", z="finally", R="return yield", T="throw assert", S="switch", b="break continue", Z="case default", n="true false null this super", O="instanceof", r="int long short byte char boolean float double void"),
    angles="java",
)


def java_productions() -> dict[str, str]:
    note = r"(?:@i(?:\.i)*P?)*"
    some = r"(?:@i(?:\.i)*P?)"
    type_ = rf"(?:(?:i(?:\.{note}i)*|r)(?:{note}B)*)"
    new = rf"(?:W{note}(?:i(?:\.i)*(?:PC?|B+C?)|rB+C?))"
    lambda_ = r"(?:(?:i|P)a)"
    operand = rf"(?:(?:[upx]|P(?=[insPuWpxSr])|{lambda_})*(?:{new}|[insP]|rB*(?=\.)|iB+(?=\.)|SPC|(?<=a)C)(?:\.(?:[in]|{new}|W|K)|P|B|x)*(?:Ov*{type_}P?i?)?)"
    expr = rf"(?:{operand}(?:[ope]{operand}|\?(?=[^;]*:)(?:{operand}[ope?:])+{operand})*)"
    init = rf"i(?:B)*(?:e(?:{expr}|C))?"
    var = rf"{note}v*{note}{type_}{init}(?:,{init})*"
    member_var = rf"{note}[vV]*{note}{type_}{init}(?:,{init})*"
    raises = rf"(?:G{note}{type_}(?:,{note}{type_})*)"
    case = rf"(?:v*{type_}P?i?(?:i{expr})?|{expr}|Z)"
    clause = rf"Z(?:{case}(?:,{case})*)?(?::|a)"
    simple = rf"(?:{var}|R(?:{expr})?|T{expr}(?::{expr})?|bi?|{expr})"
    block = rf"(?:(?:yP)?C|t(?:PC(?:hPC)*(?:zC)?|C(?:hPC)+(?:zC)?|CzC)|SPC|d(?:C|{simple};)wP;)"
    lead = r"(?:IP|(?<=[C;])L|fP|wP|i:)*"
    method = rf"{note}(?:[vVyZ]|{some})*(?:{type_})?iPB*{raises}*(?:C|;|Z(?:{expr}|C|{some}+);)"
    class_ = rf"{note}(?:[vV]|{some})*[KE]iP?{raises}*C"
    member = rf"(?:;|{class_}|{method}|{member_var};|V?C)"
    compact = rf"{note}V?iC"
    consts = rf"(?:{note}iP?C?(?:,{note}iP?C?)*,?)?"
    line = rf";|{class_}|{lead}{block}|{lead}{simple};|{lead};"
    lines = rf"(?>{line})*+"
    clauses = rf"(?=Z|$)(?>{line}|{clause}(?:{lead}{block}|{lead}{simple};|(?=Z|$))|{clause})*+"
    top = rf"(?:{note}ki(?:\.i)*;)?(?:;|MV?i(?:\.i)*(?:\.o)?;)*(?>;|{class_})*+(?:{note}i{{1,2}}(?:\.i)*C)?"
    formal = rf"{note}v*{note}{type_}{note}D?(?:i|n)(?:\.n)?B*"
    value = rf"(?:ie)?(?:C|{some})"
    param = rf"(?:{formal}|{expr}|{note}{type_}(?:o{type_})*|{value})"
    loop = rf"(?:(?:{var}|{expr}(?:,{expr})*)?;(?:{expr})?;(?:{expr}(?:,{expr})*)?|{note}v*{note}{type_}iB*:{expr})"
    resource = rf"(?:{var}|{expr})"
    values = rf"(?:(?:{expr}|C|{some})(?:,(?:{expr}|C|{some}))*,?)?"
    return {
        "file": top, "(": rf"(?:{param}(?:,{param})*)?", "params": rf"(?:{formal}(?:,{formal})*)?", "cond": expr, "loop": loop, "catch": rf"{note}v*{type_}(?:o{type_})*i", "resources": rf"{resource}(?:;{resource})*;?",
        "[": rf"(?:{expr})?", "block": lines, "switch": clauses, "class": rf"(?>{member})*+", "record": rf"(?>{compact}|{member})*+", "enum": rf"{consts}(?:;(?>{member})*+)?", "values": values, "module": r"(?:[iWGVZ.,on]+;)*", "{": "(?!)",
    }


def java_context(outer: str, before: str, bracket: str) -> str:
    if bracket == "[":
        return bracket
    if bracket == "(":
        if re.search(r"@i(?:\.i)*$", before):
            return bracket
        if re.search(r"(?:^|[^.])[IwSy]$", before):
            return "cond"
        if before.endswith(("f", "h", "t")):
            return {"f": "loop", "h": "catch", "t": "resources"}[before[-1]]
        part = re.split(r"[;C]", before)[-1]
        if outer in ("class", "record") and part.endswith("i") and "e" not in part or re.search(r"K(?:i)$", before):
            return "params"
        return bracket
    declared = re.search(r"([KE])i(P)?(?:G[i.,B@P]*)*$", before)
    if declared:
        return "enum" if declared[1] == "E" else "record" if declared[2] else "class"
    if outer == "file" and re.search(r"(?:^|[;C])(?:@i(?:\.i)*P?)*i{1,2}(?:\.i)*$", before):
        return "module"
    if re.search(r"Wi(?:\.i)*P$", before):
        return "class"
    if outer == "enum" and ";" not in before and before[-1:] in ("i", "P"):
        return "class"
    if re.search(r"(?:^|[^.])SP$", before):
        return "switch"
    if before.endswith("a"):
        return "block"
    if before[-1:] in ("e", "B", ",", "R") and not (before.endswith("B") and re.search(r"PB+$", before)) or before.endswith("Z") and outer != "switch" or outer in ("(", "[", "values"):
        return "values"
    if outer in ("class", "enum", "record"):
        return "block" if re.search(r"(?:^|[;C]|[;C]?V|PB*(?:G[i.,B]*)*)$", before) or (outer == "record" and re.search(r"(?:^|[;CV]|@i)i$", before)) else "{"
    if outer in ("block", "switch"):
        return "block" if not before or before[-1] in ";CPLtzdy:" else "{"
    return "{"


# JSON, read strictly; an exact reader decides about what is flagged
JSON = Lexer([(r"\"(?:\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4})|[^\"\\\x00-\x1f])*\"", "s"), (r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+\-]?\d+)?(?![\w.])", "n"), (r"(?:true|false|null)(?!\w)", "n"), (r"[,:]", "self"), (r"[()\[\]{}]", "bracket")], {})
JSON_PRODUCTIONS = {"file": "[snBC]", "(": "(?!)", "[": "(?:[snBC](?:,[snBC])*)?", "{": "(?:s:[snBC](?:,s:[snBC])*)?"}

# TOML: a line end is a token; an exact reader decides about what is flagged
TOML = Lexer(
    [
        (r"#[^\n]*", "comment"),
        (r"\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"+|'''[\s\S]*?'''+", "s"),
        (r"\"(?:\\.|[^\"\\\n])*\"|'[^'\n]*'", "s"),
        (r"[+\-]?(?:inf|nan)(?![\w\-])|\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d:\d\d(?:\.\d+)?(?:Z|[+\-]\d\d:\d\d)?)?|\d\d:\d\d:\d\d(?:\.\d+)?", "n"),
        (r"[+\-]?(?:0[xob][\da-fA-F_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+\-]?\d+)?)(?![\w\-])", "n"),
        (r"(?:true|false)(?![\w\-])", "n"),
        (r"[A-Za-z0-9_\-]+", "i"),
        (r"=", "e"),
        (r"[.,]", "self"),
        (r"[()\[\]{}]", "bracket"),
    ],
    {},
    ends="insPBC)]}",
    starts="ins[{([",
    newline=True,
)
TOML_KEY = r"(?:[ins](?:\.[ins])*)"
TOML_PRODUCTIONS = {"file": rf"(?>;|(?:B|{TOML_KEY}e[nsBC])(?:;|$))*+", "(": "(?!)", "[": rf"(?:;*(?:[nsBC];*(?:,;*[nsBC];*)*,?;*)?|{TOML_KEY}|B)", "{": rf"(?:{TOML_KEY}e[nsBC](?:,{TOML_KEY}e[nsBC])*)?"}

# Python: logical lines end in ';', blocks are '>' and '<'; an exact reader decides about what is flagged
PYTHON_STRING = r"(?:[rRbBuUfF]{0,2})(?:\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"|'''(?:\\[\s\S]|[^\\])*?'''|\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*')"
PYTHON = Lexer(
    [
        (r"#[^\n]*", "comment"),
        (r"\\\n", ""),
        (PYTHON_STRING, "s"),
        (r"0[xXoObB][\da-fA-F_]+(?!\w)|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+\-]?\d+)?[jJ]?(?!\w)", "n"),
        (WORD, "word"),
        (r"\.\.\.", "n"),
        (r"->", "a"),
        (r"\*\*=|//=|<<=|>>=|[+\-*/%&|^@]=", "e"),
        (r":=", "q"),
        (r"==|!=|<=|>=|<<|>>|//", "o"),
        (r"=", "e"),
        (r"\*\*|\*", "*"),
        (r"[+\-]", "p"),
        (r"[/%<>&|^]", "o"),
        (r"@", "@"),
        (r"~", "u"),
        (r"[.,;:]", "self"),
        (r"[()\[\]{}]", "bracket"),
    ],
    keys(F="def", K="class", I="if", L="else", l="elif", f="for", q="in", w="while", t="try", h="except", z="finally", W="with", k="as", R="return", T="raise", A="assert", b="pass break continue", M="import", m="from", g="global nonlocal", d="del", o="and or is", u="not await", y="async", Y="yield", j="lambda", n="True False None"),
)


def python_productions() -> dict[str, str]:
    operand = r"(?:[pu*]*(?:[inPBC]|s+)(?:\.i|P|B)*)"
    part = rf"(?:(?:j(?:i(?:,i)*)?:)*{operand})"
    expr = rf"(?:{part}(?:(?:[op*@q]|uq|ou){part}|I{part}L{part})*)"
    many = rf"(?:{expr}(?:,{expr})*,?)"
    simple = rf"(?:{many}(?::{expr})?(?:e(?:Y?m?{many}))*|R(?:{many})?|T(?:{expr}(?:m{expr})?)?|A{expr}(?:,{expr})?|b|Mi(?:\.i)*(?:ki)?(?:,i(?:\.i)*(?:ki)?)*|m[.n]*(?:i(?:\.i)*)?M(?:\*|P|i(?:ki)?(?:,i(?:ki)?)*)|gi(?:,i)*|d{many}|Ym?(?:{many})?)"
    head = rf"(?:y?FiP(?:a{expr})?|KiP?|I{expr}|l{expr}|L|w{expr}|y?f{many}q{many}|t|h(?:{many}(?:ki)?)?|z|y?W{expr}(?:k{expr})?(?:,{expr}(?:k{expr})?)*)"
    line = rf"(?:@{expr};|{head}:;?>|{head}:{simple};|{simple};|<)"
    comp = rf"(?:{expr}(?::{expr})?(?:y?f{many}q{expr}(?:I{expr})*)+)"
    item = rf"(?:{expr}(?::{expr})?(?:e{expr})?|(?:{expr})?:(?:{expr})?(?::(?:{expr})?)?|\*)"
    inner = rf"(?:{comp}|(?:{item}(?:,{item})*,?)?|Ym?{expr}|i(?:ki)?(?:,i(?:ki)?)*,?)"
    order = r"(?:t(?:h+L?z?|z)|Il*L?|[fw]L?|s)*"  # which parts of compound statements follow which
    return {"file": rf"(?:{line})*", "block": order, "(": inner, "[": inner, "{": inner}
