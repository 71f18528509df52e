import json

from segweave.operators import transforms as t

CODE = {
    "a.rs": "impl Foo {\n    pub fn bar(&self) -> u32 {\n        let s = \"}{\";\n        let x = 1;\n        x\n    }\n    fn tiny() { 1 }\n}\n",
    "a.go": "func (s *S) Foo(a int) error {\n\tif a > 1 {\n\t\treturn nil\n\t}\n\treturn nil\n}\n",
    "a.ts": "class A {\n  method(a: number) {\n    const c = `}`;\n    if (a) { return c; }\n    return a;\n  }\n}\nconst f = (x) => {\n  one();\n  two();\n  three();\n};\n",
    "A.java": "class A {\n  A(int x) {\n    this.x = x;\n    this.y = x;\n    this.z = 1;\n  }\n  int m() throws E {\n    a();\n    b();\n    return 1;\n  }\n}\n",
    "a.c": "int main(int argc) {\n  for (int i = 0; i < 3; i++) {\n    x();\n  }\n  return 0; // }\n}\n",
    "a.pl": "sub foo {\n  my $x = shift;\n  my $y = 1;\n  return $x;\n}\n",
    "a.py": "class A:\n    def f(self):\n        x = 1\n        y = 2\n        return x\n\n    def g(self): return 1\n",
}


def test_skeletons_hide_bodies_and_keep_signatures():
    for path, code in CODE.items():
        out = t.skeleton(code, path)
        assert out is not None and "lines hidden" in out and len(out) < len(code), path
    assert "pub fn bar(&self) -> u32 { /* 3 lines hidden */ }" in t.skeleton(CODE["a.rs"], "a.rs")
    assert "fn tiny() { 1 }" in t.skeleton(CODE["a.rs"], "a.rs")
    assert t.skeleton(CODE["A.java"], "A.java").count("hidden") == 2
    assert "# 3 lines hidden" in t.skeleton(CODE["a.py"], "a.py") and "def g(self): return 1" in t.skeleton(CODE["a.py"], "a.py")


def test_skeleton_refusals():
    assert t.skeleton("anything", "a.txt") is None
    assert t.skeleton("fn a() { 1 }\n", "a.rs") is None
    assert t.skeleton("def broken(:\n", "a.py") is None
    assert t.skeleton(None or "", "a.rs") is None


def test_broken_braces_are_said():
    out = t.skeleton(CODE["a.rs"] + "fn open() {\n", "a.rs")
    assert out.startswith("// [parse errors")


def test_telegraphic_keeps_facts():
    text = "The server was restarted on Monday because the cache had grown to 947 milliseconds and it was not possible to serve all of the requests within time"
    out = t.telegraphic(text)
    assert "947 milliseconds" in out and "Monday" in out and " the " not in out
    assert t.telegraphic("too short to say") is None


def test_lossy_lines_cap_and_truncate():
    lines = [f"user{i} {i}.0 proc {'x' * 60}" for i in range(200)]
    lines[137] = "error: disk full " + "y" * 60
    out = t.Lossy(3, most_chars=30, most_rows=12).compact("\n".join(lines))
    assert "error: disk full" in out and "188 of 200 lines elided" in out and max(map(len, out.split("\n")[:-1])) <= 31


def test_lossy_rows_keep_ends_and_anomalies():
    rows = [{"id": i, "status": "ok", "text": "all is well"} for i in range(100)]
    rows[50]["status"] = "CRITICAL"
    out = t.Lossy(3).compact(json.dumps(rows))
    kept = [json.loads(x)["id"] for x in out.split("\n")[:-1]]
    assert kept == [0, 1, 2, 50, 97, 98, 99] and "93 of 100" in out


def test_lossy_keeps_what_the_task_names():
    rows = [{"id": i, "name": f"n{i}"} for i in range(50)]
    rows[20]["name"] = "jwt_auth"
    assert '"jwt_auth"' in t.Lossy(2, task="look at jwt_auth").compact(json.dumps(rows))
    assert t.Lossy(3).compact("a\nb\nc\nd\ne") is None


def test_csv():
    rows = [f"{i},item,ok" for i in range(100)]
    rows[40], rows[60] = "40,item,FAILED", "60,only two"
    out = t.compact_csv("id,name,status\n" + "\n".join(rows), 3)
    assert out.split("\n")[0] == "id,name,status" and "40,item,FAILED" in out and "60,only two" in out and "… 37 rows omitted …" in out
    assert t.compact_csv("id,name,status\n" + "\n".join(rows), 3, 1) == out
    assert t.compact_csv("just text\nwithout\ncolumns", 3) is None and t.compact_csv("", 3) is None


def test_html():
    page = '<html><head><style>p{}</style><script>var a="</p>";</script></head><body class="x" onclick="a()"><!-- no --><p style="a" data-x="1" id="k">Hi   there</p>\n\n</body></html>'
    out = t.compact_html(page)
    assert out == '<html><head></head><body><p id="k">Hi there</p>\n</body></html>'
    assert t.compact_html("no markup") is None


def test_images_come_back():
    text = f"see {t.png_uri()} and {t.png_uri(b'other')}"
    out = t.deref_images(text)
    assert out.count("[image id=") == 2 and t.put_images(out, t.inline_images(text)) == text
    assert t.deref_images("none here") is None


def test_schema():
    schema = {"$schema": "x", "title": "t", "type": "object", "properties": {"title": {"type": "string", "title": "gone", "examples": [1]}}, "description": "stays"}
    assert json.loads(t.slim_schema(json.dumps(schema))) == {"type": "object", "properties": {"title": {"type": "string"}}, "description": "stays"}
    assert t.slim_schema("{}") is None and t.slim_schema("no") is None


def test_symbols():
    assert t.symbols_of("fix the auth bug in src/jwt.rs TokenExpiredError") == {"auth", "bug", "src/jwt.rs", "tokenexpirederror"}
