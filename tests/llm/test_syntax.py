import datetime as dt
import pathlib

import pytest

from tessera.llm import syntax

GOOD = {
    "a.ts": ["const a: number = f<T>(x, (y) => y + 1);\nexport default class A extends B implements C { private x?: string = 'a'; get y(): number { return 1; } }\n", "", "type X = string | null;\nif (a) { b(); } else if (c) d(); else { e(); }\nfor (const [k, v] of Object.entries(o)) log(`x ${k} {`);\n", "interface P { a: string; b?: number[]; }\nlet z = a ? b : c, w = { k: 1, 'l': [2, 3], ...rest, m() { return 1 } };\n", "import x, { y as z, type W } from './m';\n// ((( [\nconst r = s.split(/[,;)]/g);\n"],
    "a.js": ["const f = async function (x) { return await g(x); };\nmodule.exports.f = f\n", "try { a(); } catch (err) { b(err); } finally { c(); }\nwhile (x < 3) { x++; }\n"],
    "a.go": ["package a\n\nimport (\n\t\"fmt\"\n)\n\n// ((\nfunc (s *S) F(a []int, b string) (int, error) {\n\tif err := g(); err != nil {\n\t\treturn 0, err\n\t}\n\tfor _, v := range a {\n\t\tfmt.Println(v, '{', `raw \" (`)\n\t}\n\tm := map[string]int{\"a\": 1}\n\tdefer f.Close()\n\treturn m[\"a\"], nil\n}\n", "package b\n\ntype T struct {\n\tA int `json:\"a\"`\n\tB []string\n}\n\nvar x, y = 1, 2\n"],
    "a.rs": ["use a::b::C;\n\n/* ( */\npub fn f<'a>(x: &'a str, v: Vec<u32>) -> Option<&'a str> {\n    let mut y = vec![1, 2];\n    let c = '{';\n    for i in v.iter() { if *i > 3 { y.push(*i); } }\n    let s = v.iter().map(|q| q + 1).sum::<i64>();\n    println!(\"{}\", s);\n    while a < 3 { b(); }\n    match x { \"a\" => Some(x), _ => None }\n}\n"],
    "A.java": ["package a.b;\n\nimport java.util.*;\n\npublic class A<T> extends B {\n    private final List<String> x = new ArrayList<>();\n    public static int f(int a, List<String> b) throws E {\n        for (String s : b) { if (s.length() > 3) { x.add(s); } else { return 1; } }\n        char c = '}'; int record = 2;\n        throw new IllegalStateException(\"a ( b\");\n    }\n}\n"],
    "a.py": ["def f(a, *, b=1) -> int:\n    x = [i for i in a if i > 1]\n    with g(1) as h:\n        return {'a': x[1:2], **b}\n", "\n", "@d\nasync def f():\n    s = '''\n<<<<<<< a\n'''\n    await g(\n        1,\n    )\n", "try:\n    a()\nexcept (A, B) as e:\n    pass\nelse:\n    b()\nfinally:\n    c()\nif x: y()\nelif z:\n    pass\nelse: w()\nfor i in j:\n    pass\n"],
    "a.json": ['{"a": [1, 2.5e3, null, "x\\n"], "b": {}}', "[]", '"s"'],
    "a.toml": ['a = 1\n[t.u]\nb = ["x", "y",]\nc = { d = 1.5 }\n# [\n', ""],
    "a.yaml": ["a: 1\nb:\n  - x\n  - y: [1, 2]\nc: |\n  <<<<<<< HEAD\n  text\nd: \"q: {\"\n", '{\n  "a": [\n    1\n  ]\n}\n', "a:\n- b\n- c\n"],
    "a.sh": ["#!/bin/bash\nset -eu\nf() {\n  if [ \"$A\" = \"b\" ]; then\n    echo \"x ( $B\"\n  fi\n  for X in a b; do\n    Y=$((  1 + 2 ))\n  done\n  [ -n \"$Z\" ] && echo 'q' | grep x > /dev/null 2>&1\n  return 0\n}\ncat <<'TXT'\n>>>>>>> not a conflict (\nTXT\ncase \"$1\" in\n  a|b) echo 1 ;;\n  *) echo 2 ;;\nesac\n"],
    "a.md": ["``` {{{ ((", "<<<<<<< x"],
    "a.bin": ["((("],
}
BAD = {
    "a.ts": ["const a\n", "f(1\n", "<<<<<<< HEAD\nf();\n=======\ng();\n>>>>>>> x\n", "@@ -1,2 +1,2 @@\nf();\n", "function f(a: number { return a; }\n", "let a = 'x;\n", "The helper was moved to the team.\n", '{\n  "a": 1,\n  "b": 2\n}\n', "const x = [1, 2;\n", "f();\n}\n", "const a = “x”;\n"],
    "a.js": ["import { a, type B } from './b';\n", "function f(a: number): number { return 1; }\n"],
    "a.go": ["func f() {}\n", "package a\n\nfunc f( {\n}\n", "package a\n\nfunc f() {\n\ta := 1\n", "package a\n\nx y z\n"],
    "a.rs": ["fn f(a: u32 -> u32 { a }\n", "fn f() {\n    let x = beaco\n", "pub fn f() { >>>>>>> x\n}\n", "package a\n"],
    "A.java": ["class A { void f() { int a = 1 } }\n", "class A { void f() { g(; } }\n", "package a\n\nimport (\n\"log\"\n)\n"],
    "a.py": ["def f(:\n    pass\n", "def f():\nreturn 1\n", "print 'x'\n", "a = [1, 2\n", "def f():\n      a = 1\n    b = 2\n", "<<<<<<< HEAD\n", "def f():\n    try:\n        a = 1\n", "else:\n    pass\n"],
    "a.json": ['{"a": 1,}', "", "a,b\n1,2\n", '{"a": NaN}', '{"a" 1}'],
    "a.toml": ["a : 1\n", "=======\n", 'a = "x\n'],
    "a.yaml": ["a: [1, 2\n", "a: 1\n<<<<<<< HEAD\nb: 2\n", 'a: "x\nb: 1\n'],
    "a.sh": ["if [ 1 ]; then\n  echo\n", "f() {\n", "echo 'x\n", "done\n", "def f(a, b):\n  pass\n", "f() {\n  if [ 1 ]; then\n    echo 1\n  }\nfi\n"],
}
SCHEMA = "file_id bigint, repo string, file_path string, content string, scanned_at timestamp_ntz, language string, at int, a string, part string"
T = dt.datetime(2025, 1, 1)


def frame(spark, files):
    return spark.createDataFrame([(i, "r", p, c, T + dt.timedelta(hours=h), "wrong", 0, "", "") for i, p, c, h in files], SCHEMA)


def test_good_and_bad_files(spark):
    files, want = [], set()
    for group, bad in ((GOOD, False), (BAD, True)):
        for path, texts in group.items():
            for text in texts:
                files.append((len(files), path, text, 0))
                if bad:
                    want.add(len(files) - 1)
    got = {r[0] for r in syntax.failing(syntax.current_files(frame(spark, files))).collect()}
    label = {f[0]: (f[1], f[2]) for f in files}
    assert not [label[i] for i in want - got], "missed"
    assert not [label[i] for i in got - want], "wrongly flagged"


def test_repeated_rows_nulls_line_ends_and_rates(spark, rows):
    files = [(1, "a.json", "{", 0), (1, "a.json", "{}", 1), (2, "a.json", "{}", 0), (2, "a.json", "{", 1), (3, "a.json", None, 0), (4, "a.py", "﻿def f():\r\n    return 1\r\n", 0), (5, "x", None, 0)]
    current = syntax.current_files(frame(spark, files))
    bad = syntax.failing(current)
    assert rows(bad) == [(2,)]
    stats = spark.createDataFrame([("r", ["a.json", None]), ("r", None), ("r", [])], "repo string, parse_failures array<string>")
    got = {r["language"]: (r["n_files"], r["n_failed"], r["n_reported"], r["n_both"]) for r in syntax.failure_rates(current, bad, stats).collect()}
    assert got == {"json": (3, 1, 3, 1), "python": (1, 0, 0, 0), "other": (1, 0, 0, 0)}


def test_empty(spark, rows):
    assert rows(syntax.failing(syntax.current_files(frame(spark, [])))) == []


@pytest.mark.parametrize("language", ["go", "json", "typescript"])
def test_permitted_pairs_come_from_productions(language):
    pairs = syntax.permitted(language)
    assert ("n", "n") not in pairs and ("{", "}") in pairs


@pytest.mark.parametrize(("path", "before", "body", "after"), [("a.ts", "", "if (a > 1) { b(); }\nconst x: number = y ? 1 : 2;\n", ""), ("a.rs", "fn q() {\n", "let x = g(1);\nif a > 1 { b(); }\n", "}\n"), ("A.java", "class A {\n", "int f(int a) { x.add(1); if (a > 1) { b(); } }\n", "}\n"), ("a.sh", "", "if [ 1 ]; then\n  echo 1\nfi\n", "")])
def test_long_files_that_end_badly_take_no_long_time(path, before, body, after):
    import time

    began = time.time()
    for tail, bad in (("", False), (") ]\n", True)):
        language = syntax.EXTENSIONS[path.rsplit(".", 1)[1]]
        _, _, shapes = syntax.lexed(language, before + body * 400 + tail + after)
        assert any(not syntax.fits(language, *x) for x in shapes) == bad
    assert time.time() - began < 15


KINDS_OF_BLOCK = {
    "go": [
        'package a\n\nfunc f(x interface{}) {\n\tswitch y := x.(type) {\n\tcase int, []string:\n\t\tg(y)\n\tcase nil:\n\tdefault:\n\t\treturn\n\t}\n}\n',
        'package a\n\nfunc f() {\n\tfor _, x := range []int{1, 2} {\n\t\tp := T{A: 1, B: []U{{1, 2}, {3, 4}}}\n\t\tgo func() {\n\t\t\tdefer m.Unlock()\n\t\t}()\n\t}\n\tif v, ok := m[k]; ok {\n\t\tx = struct{}{}\n\t} else if y {\n\t\tz()\n\t} else {\n\t\tw()\n\t}\n\tselect {\n\tcase x := <-ch:\n\t\tg(x)\n\tdefault:\n\t}\n\tm := map[string][]int{"a": {1}, "b": {2}}\n\tfor i := 0; i < 3; i++ {\n\t\tcontinue\n\t}\n\tfor {\n\t\tbreak\n\t}\n\t{\n\t\tx++\n\t}\n\treturn &T{a, b}\n}\n',
        'package a\n\ntype I interface {\n\tF(a int) error\n\tio.Reader\n}\n\ntype S struct {\n\tA, B int\n\t*T\n\tf func(int) error\n\tm map[string]interface{}\n\tn struct {\n\t\tx int\n\t}\n}\n\nvar t = []struct {\n\ta int\n}{\n\t{1},\n\t{a: 2},\n}\n\nvar f = func(a int) []int { return []int{a} }\n',
        'package a\n\nfunc f() func(int) error {\n\tswitch {\n\tcase a > 1 && g(func() bool { return true }):\n\t\tif x { return nil }\n\t\tfallthrough\n\tcase b:\n\t\ty := 0x1F + 1e3 + 3i\n\t}\n\tif f := func() bool { return true }; f() {\n\t\tg()\n\t}\n\tl = append(l, T{1})\n\tch <- T{1}\n\treturn func(x int) error {\n\t\treturn nil\n\t}\n}\n',
    ],
    "rust": [
        'impl<T> A for B {\n    const X: u8 = 1;\n    type Y = u8;\n    fn f(&self) -> impl Fn(i32) -> i32 {\n        let p = P { x: 1, y, ..q };\n        if let Foo { a, .. } = p { g(); }\n        match p {\n            P { x, y: 2 } => Q { z: x },\n            Some(n) if n > 1 => { h(); }\n            A::B | A::C => match z { 1 => 2, _ => 3 },\n            _ => {}\n        }\n    }\n}\n',
        '#[derive(Debug)]\npub struct S {\n    pub a: u32,\n    b: Vec<u8>,\n}\npub enum E {\n    A,\n    B(u8),\n    C { x: u8 },\n    D = 3,\n}\npub trait T {\n    fn f(&self);\n    fn g() -> u8 { 1 }\n}\nmod m {\n    use super::*;\n    fn h() {}\n}\nuse a::{b, c::{d, e}};\n',
        'fn f() {\n    let x = if a { 1 } else { 2 };\n    let y = match z { 0x1fu8 => 1.5f32, _ => 2.0 };\n    let t = thread::spawn(move || { g(); });\n    let r = unsafe { h() };\n    loop { break; }\n    for Foo { a, b } in v { g(a); }\n    while let Some(q) = it.next() { k(q); }\n    let Some(v) = o else { return; };\n    struct L { a: u8 }\n    v.iter().map(|p| Q { a: p }).collect()\n}\n',
        'fn f() -> R {\n    let c = |x: u8| -> u8 { x };\n    let Foo { a, b } = g();\n    Ok(R { a, b: 1_000u64 })\n}\n',
    ],
    "java": [
        '@A({1, 2})\npublic enum E implements I {\n    A(1) { int f() { return 1; } }, B(2);\n    private final int x;\n    E(int x) { this.x = x; }\n}\n',
        'class A {\n    static int y = 0x1FL + 2;\n    static { y = 1; }\n    { y = 2; }\n    int[] a = {1, 2};\n    Runnable r = () -> { f(); };\n    A() { super(); }\n    int f(int b) throws E, F {\n        switch (b) { case 1: case 2: g(); break; default: h(); }\n        int z = switch (b) { case 1 -> 2; default -> { yield 3; } };\n        int[][] m = {{1}, {2}};\n        x = new int[] {1, 2};\n        try (R q = g()) { h(); } catch (E | F e) { i(); } finally { j(); }\n        do { k(); } while (x);\n        synchronized (this) { l(); }\n        for (int i = 0; i < 3; i++) { m(); }\n        foo(new B() { void f() { g(); } });\n        class L { int w; }\n        { int v = 1; }\n        if (a) { b(); } else if (c) { d(); } else { e(); }\n        return x -> { return y; };\n    }\n    interface J { void f(); default int g() { return 1; } }\n    enum K { A, B, }\n    enum M { A }\n}\n',
        '@interface X { String[] value() default {}; int n() default 1; }\nrecord P(int a, int b) { int s() { return a + b; } }\n',
        'public record Q(String a) implements I {\n    static int x = 1;\n}\n',
    ],
    "typescript": [
        "const f = (a: number): number => { return a; };\nclass A { private x = 1; static m(): void { g(); } get y(): string { return 'a'; } constructor(private z: number) { super(); } }\nswitch (x) { case 1: f(); break; case 'a': { g(); } default: h(); }\nconst o: { a: string; b(): void } = { a: 1, m(): number { return 1; }, get z() { return 2; }, async q() { await r(); } };\nfunction g<T>(x: { a: T }): { b: T } { return { b: x.a }; }\nenum E { A = 1, B }\ntype U = { a: string } | { b: number };\ninterface I { a: { b: string }; f(x: number): void; }\nexport { a, b as c };\nexport default { a: 1 };\nconst n = 10n + 0xFFn + 1_000 + 1e5;\n",
    ],
    "javascript": [
        "class A { x = 1; m() { g(); } static async n() { return { a: 1 }; } }\nconst { a, b: { c } } = d;\nlabel: for (;;) { break label; }\nswitch (x) { case 1: { y(); } default: z(); }\nexport const q = { m() { return 1; }, 'k': 2 };\nif (a) { b() } else { c() }\nconst f = async () => { };\n",
    ],
}
WRONG_KIND_OF_BLOCK = {
    "go": [
        'package a\n\nfunc f() { a int }\n',
        'package a\n\nfunc f() { a: 1, b: 2 }\n',
        'package a\n\ntype S struct { return 1 }\n',
        'package a\n\ntype S struct {\n\tf() error\n}\n',
        'package a\n\ntype I interface {\n\ta int `x`\n}\n',
        'package a\n\nvar x = T{ a := 1 }\n',
        'package a\n\nfunc f() {\n\tcase 1:\n\tg()\n}\n',
        'package a\n\nfunc f() {\n\tswitch x {\n\tg()\n\t}\n}\n',
        'package a\n\nvar x = 12abc\n',
        'package a\n\nfunc f() {\n\tif x { a: 1, b: 2 }\n}\n',
    ],
    "rust": [
        'fn f() { a: u8, b: u8 }\n',
        'struct S { let x = 1; }\n',
        'struct S { A(u8), B }\n',
        'enum E { a: u8 }\n',
        'fn f() { match x { g(); } }\n',
        'fn f() { 1 => 2, _ => 3 }\n',
        'impl A { let x = 1; }\n',
        'trait T { x = 1; }\n',
        'fn f() { let x = P { g(); }; }\n',
        'fn f() { let x = 12abc; }\n',
        'mod m { let x = 1; }\n',
        'fn f() { if x { 1 => 2 } }\n',
        'impl A { struct B { a: u8 } }\n',
    ],
    "java": [
        'class A { return 1; x = 2; }\n',
        'class A { void f() { void g() { } } }\n',
        'class A { A, B; }\n',
        'class A { void f() { A, B } }\n',
        'enum E { return 1; }\n',
        'class A { void f() { case 1: g(); } }\n',
        'class A { void f() { switch (x) { g(); } } }\n',
        'class A { int[] x = { return 1; }; }\n',
        'class A { int x = 12abc; }\n',
        'class A { if (x) { } }\n',
        'class A { void f() { private int g; } }\n',
        'class A { void f() { public void g(); } }\n',
        'interface I { x = 1; }\n',
    ],
    "typescript": [
        'const x = 3px;\n',
        'const a = 12abc;\n',
        'if (a) { x: 1, y: 2 }\n',
        'class A { return 1; }\n',
        'class A { m(): void { a: 1, b: 2 } }\n',
        'const o = { return 1; };\n',
        'function f(): number { a: 1, b: 2 }\n',
        'function f(): void { m() { } }\n',
        'enum E { return 1; }\n',
        'interface I { if (x) { } }\n',
        'switch (x) { f(); }\n',
        "import { return } from 'a';\n",
    ],
    "javascript": [
        'const x = 3px;\n',
        'const a = 12abc;\n',
        'class A { return 1; }\n',
        'class A { m() { a: 1, b: 2 } }\n',
        'const o = { m() { x() { } } };\n',
        'switch (x) { f(); }\n',
        'const { return 1 } = x;\n',
    ],
}


def flagged(language, text):
    pairs, marks, shapes = syntax.lexed(language, text)
    open_ = []
    for _, kind in marks:
        if kind in syntax.NESTS:
            open_.append(kind)
        elif not open_ or syntax.NESTS[open_.pop()] != kind:
            return True
    return bool(open_) or bool(pairs - syntax.permitted(language)) or any(not syntax.fits(language, *x) for x in shapes)


@pytest.mark.parametrize("language", ["go", "rust", "java", "typescript", "javascript"])
def test_what_stands_in_a_block_fits_its_kind(language):
    assert [x for x in KINDS_OF_BLOCK[language] if flagged(language, x)] == []
    assert [x for x in WRONG_KIND_OF_BLOCK[language] if not flagged(language, x)] == []


CASES = pathlib.Path(__file__).parent / "cases"


def cases(language, kind):
    return (CASES / f"{language}.{kind}").read_text().split("\n%%\n")


@pytest.mark.parametrize("language", ["typescript", "javascript", "go", "rust", "java", "bash", "yaml"])
def test_forms_of_the_languages(language):
    """Constructs of each language and texts that break it, read without any exact reader."""
    assert [x for x in cases(language, "valid") if flagged(language, x)] == []
    assert [x for x in cases(language, "invalid") if not flagged(language, x)] == []


@pytest.mark.parametrize("language", ["typescript", "rust", "java", "bash"])
def test_long_type_lists_and_templates_stay_linear(language):
    import time

    began = time.time()
    for text in ("a < " * 20_000, "<" * 20_000, "`${" * 20_000, '"$(' * 20_000, "<a b={" * 20_000, "(" * 20_000 + ")" * 20_000, "[[ " * 20_000):
        syntax.lexed(language, text)
    assert time.time() - began < 20


def test_deep_nesting_keeps_its_flag():
    assert syntax.exact_failure("json", "[" * 100_000)
    assert syntax.exact_failure("python", "(" * 100_000)
