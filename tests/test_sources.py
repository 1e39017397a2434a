from pyspark.sql import functions as F

from pathmine.operators import preprocess as PP
from pathmine.operators import traverse as T
from pathmine.sources import dot as DOT
from pathmine.sources import files as FS

C_FILE = """#include <stdio.h>
#define N 3
// a comment with an apostrophe: don't
static int add(int a, int b) {
  return a + b; /* sum */
}
int Foo::bar(const char* s) const {
  if (s) { printf("}"); }
  return 'x';
}
void onel(void) { x(); }
"""


def test_find_functions_cases():
    names = [n for n, _ in PP.find_functions(C_FILE)]
    assert names == ["add", "bar", "onel"]
    code = dict(PP.find_functions(C_FILE))
    assert code["bar"].startswith("int bar (const char* s) const \n{")
    assert code["onel"].endswith("{ x(); }")
    odd = "int x;\nint f(int a) {\n char c = '\\''; char *s = \"\\\"}\"; }\nint g(int b) { return b; }"
    assert [n for n, _ in PP.find_functions(odd)] == ["f", "g"]


def test_preprocess_pipeline_on_files(spark, tmp_path):
    proj = tmp_path / "src" / "proj1" / "lib"
    proj.mkdir(parents=True)
    (proj / "a.c").write_text(C_FILE)
    (proj / "notes.txt").write_text("int f(int x) { return x; }")
    (tmp_path / "src" / "loose.c").write_text("int g(void) { return 1; }")
    files = FS.scan_sources(spark, str(tmp_path / "src"))
    assert sorted(r.path for r in files.collect()) == ["proj1/lib/a.c", "proj1/lib/notes.txt"]
    out = PP.preprocess(files, 3072, "multiple").orderBy("fn_id").collect()
    assert [(r.project, r.fn_id) for r in out] == [("proj1", 0), ("proj1", 1), ("proj1", 2)]
    assert "don't" not in out[0].code and "/* sum */" not in out[0].code
    small = PP.preprocess(files, 49 + 30, "single").collect()
    assert [r.code for r in small] == ["void onel (void) \n{ x(); }"]


def test_directives_and_comments(spark):
    df = spark.createDataFrame([("a\n#include <x.h>\n#define Y 1\nb",)], "c string")
    assert df.select(PP.split_directives("c").alias("r")).collect()[0].r == "#include <x.h>\na\nb"
    df2 = spark.createDataFrame([('s = "// no"; // yes\n/* a\n b */ t',)], "c string")
    assert df2.select(PP.strip_comments("c").alias("r")).collect()[0].r == 's = "// no";  \n  t'


def test_dot_roundtrip_and_reader(spark, tmp_path):
    dot = '''digraph "fooBar" {
"1000101" [label = "(METHOD,fooBar)" ]
"1000102" [label = "(CALL,printf)" ]
"1000103" [label = "(LITERAL,x1)" ]
"1000104" [label = "(IDENTIFIER,n)" ]
  "1000101" -> "1000102"
  "1000102" -> "1000103"
  "1000102" -> "1000104"
  "1000102" -> "1000104"
}'''
    (tmp_path / "7.dot").write_text(dot)
    dumps = DOT.read_dot_files(spark, str(tmp_path / "7.dot"))
    g, n, e = DOT.parse_dot(dumps, "ast")
    assert g.collect()[0].name == "fooBar" and e.count() == 3 and n.count() == 4
    ctx = T.ast_paths(g, n, e).collect()
    assert [(r.graph_id, r.start_token, r.path, r.end_token) for r in ctx] == [("7", "x", "(LITERAL)^(CALL)_(IDENTIFIER)", "n")]
    again = DOT.parse_dot(DOT.render_dot(g, n, e), "ast")
    assert sorted(map(tuple, again[1].collect())) == sorted(map(tuple, n.collect()))
    g2, n2, e2 = DOT.parse_dot(dumps, "ddg")
    assert e2.count() == 4 and e2.where(F.col("label").isNull()).count() == 4


def test_scan_functions_skips_other_names(spark, tmp_path):
    d = tmp_path / "fns"
    d.mkdir()
    (d / "0.c").write_text("int a(void) { return 0; }")
    (d / "2.c").write_text("int b(void) { return 2; }")
    (d / "x.c").write_text("int c(void) { return 9; }")
    (d / "3.h").write_text("int h;")
    got = sorted((r.fn_id, r.code) for r in FS.scan_functions(spark, str(d)).collect())
    assert got == [(0, "int a(void) { return 0; }"), (2, "int b(void) { return 2; }")]


def test_write_modes(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException

    from pathmine.sources.records import read_records, write_records

    recs = spark.createDataFrame([("#0\nlabel:a\nfile:1.c\npath: ast\nx\tP\ty\npath: cfg\npath: cdg\npath: ddg\n",)], "record string")
    out = str(tmp_path / "r")
    write_records(recs, out)
    with pytest.raises(AnalysisException):
        write_records(recs, out)
    write_records(recs.union(recs), out, mode="ignore")  # existing output kept
    assert read_records(spark, out).count() == 1


def test_long_literals_and_comments(spark):
    long = '"' + "x" * 1_000_000 + '"'
    df = spark.createDataFrame([(f"a = {long}; int/**/cc(int b) // it's", f'digraph "g" {{\n"1" [label = {long} ]\n}}')], "c string, dot string")
    r = df.select(PP.strip_comments("c").alias("c")).first()
    said = DOT.statements(df.select(F.lit("g").alias("graph_id"), "dot")).collect()
    assert r.c == f"a = {long}; int cc(int b)  " and [(s.ids, len(s.label)) for s in said] == [(["1"], len(long))]


def test_sinks_refuse_or_skip_an_existing_output(spark, tmp_path):
    import pytest
    from pyspark.errors import AnalysisException

    from pathmine.sources import outputs as OUT

    lines = spark.createDataFrame([("train", "a x"), ("test", "b y"), (None, "c z")], "split string, line string")
    out = str(tmp_path / "splits")
    OUT.write_splits(lines, out)
    read = lambda: sorted((r.split, r.value) for r in spark.read.text(out).collect())
    assert read() == [("test", "b y"), ("train", "a x")]
    with pytest.raises(AnalysisException):
        OUT.write_splits(lines, out)
    OUT.write_splits(lines, out, "ignore")
    assert len(read()) == 2


FORMS = """// exported
strict digraph tree_1 { rankdir=LR; node [shape=box, label="not a node"];
  a [shape=box, label="(METHOD,foo)", color="label=\\"(X,y)\\""]; b[label="(CALL,p [q])"]c [ label = "(ID,z)" ] [weight=2]
  /* "x" [label="(GONE,1)"] */
  "d e" [label="(LIT,it's; \\"{\\" -> 7)"]
# line note
  a -> b -> c [label = "v"]; a:p:n -> "d e"
  subgraph cluster_0 { -1.5 [label="(NUM,1)"]; c -> -1.5 }
  b [label="(CALL,p)"]
}
"""


def test_dot_forms(spark):
    dumps = spark.createDataFrame([("g", FORMS), ("h", 'graph {a--b; {b c} -> d; "u" [label=<<b>x</b>>]}'), ("e", ""), ("n", None)], "graph_id string, dot string")
    g, n, e = DOT.parse_dot(dumps, "ddg")
    assert {r.graph_id: r.name for r in g.collect()} == {"g": "tree_1", "h": "", "e": "", "n": ""}
    nodes = sorted((r.node_id, r.type, r.token) for r in n.where("graph_id = 'g'").collect())
    assert nodes == [("-1.5", "NUM", "1"), ("a", "METHOD", "foo"), ("b", "CALL", "p"), ("c", "ID", "z"), ("d e", "LIT", 'it\'s; \\"{\\" -> 7')]
    edges = [(r.src, r.dst, r.label) for r in e.where("graph_id = 'g'").orderBy("ord").collect()]
    assert edges == [("a", "b", "v"), ("b", "c", "v"), ("a", "d e", None), ("c", "-1.5", None)]
    unread = {r.graph_id: r.unread for r in DOT.unread_statements(dumps).collect()}
    assert unread["g"] == 0 and unread["e"] == 0 and unread["h"] > 0


def test_dot_file_names_are_decoded(spark, tmp_path):
    (tmp_path / "a b+%é.dot").write_text('digraph "x" {}')
    assert [r.graph_id for r in DOT.read_dot_files(spark, str(tmp_path)).collect()] == ["a b+%é"]


def test_scan_leaves_out_bad_bytes_and_unwanted_files(spark, tmp_path):
    import random

    proj = tmp_path / "src" / "proj1"
    (proj / ".git").mkdir(parents=True)
    rnd = random.Random(4)
    blobs = [b"// caf\xe9 \xef\xbf\xbd \xef\xb7\x90 1\nint f(int a) { return 1; }\n", bytes(rnd.randrange(256) for _ in range(5000)), b"", "é　ok".encode() + b"\xf0\x9f\x98"]
    for i, b in enumerate(blobs):
        (proj / f"{i}.c").write_bytes(b)
    (proj / ".git" / "pack.c++").write_bytes(b"x" * 4000)  # hidden and empty files are not listed
    (proj / "big.c++").write_bytes(b"x" * 4000)
    (proj / "huge.c").write_bytes(b"x" * 5001)
    (proj / "notes.txt").write_bytes(b"\xff")
    files = FS.scan_sources(spark, str(tmp_path / "src"), extensions=FS.SOURCE_EXTENSIONS, max_file_size=5000)
    got = {r.path: r.content for r in files.collect()}
    assert got == {f"proj1/{i}.c": b.decode("utf-8", "ignore") for i, b in enumerate(blobs) if b} | {"proj1/big.c++": "x" * 4000}
    small = FS.scan_sources(spark, str(tmp_path / "src"), max_file_size=100)
    assert sorted(r.length for r in small.collect()) == [1, len(blobs[3]), len(blobs[0])]
    plan = small._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,100)" in plan
    names = [r.code for r in PP.preprocess(files, 3072, "single").collect()]
    assert names == ["int f (int a) \n{ return 1; }"]
    (tmp_path / "fns").mkdir()
    for i, b in enumerate(blobs):
        (tmp_path / "fns" / f"{i}.c").write_bytes(b)
    assert sorted(r.fn_id for r in FS.scan_functions(spark, str(tmp_path / "fns"), max_file_size=100).collect()) == [0, 3]


def test_records_are_split_by_bytes(spark, tmp_path):
    from pathmine.operators import dataset as D
    from pathmine.sources.records import read_datasets, read_records

    def record(i, odd):
        lines = [f"x{i}\tP{j}\ty" for j in range(i % 7)] + (["#\tP\ty", "#5\tQ\tz", "##"] if odd and i % 11 == 0 else [])
        return "\n".join([f"#{i}", f"label:n|{i}", f"file:{i}.c", "path: ast", *lines, "path: cfg", "path: cdg", "path: ddg"]) + "\n"

    for odd in (False, True):
        for eol in ("\n", "\r\n"):
            text = "\n".join(record(i, odd) for i in range(600)).replace("\n", eol)
            path = tmp_path / f"{odd}-{len(eol)}"
            path.mkdir()
            (path / "d.c2v").write_bytes(text.encode())
            keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
            spark.conf.set("spark.sql.files.maxPartitionBytes", "1500b")
            try:
                recs = read_records(spark, str(path))
                assert recs.rdd.getNumPartitions() > 1
                got = sorted((r.record for r in recs.collect()), key=lambda t: int(t[1:t.index("\n")]))
            finally:
                spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
            assert [r.replace("\r", "") for r in got] == [record(i, odd).rstrip("\n") for i in range(600)]
    both = read_datasets(spark, {"a": str(tmp_path / "False-1"), "b": str(tmp_path / "True-2")})
    assert {r.dataset: r["count"] for r in both.groupBy("dataset").count().collect()} == {"a": 600, "b": 600}
    assert D.parse_records(both).count() > 0


def test_preprocess_counts_without_a_scan(spark, monkeypatch):
    """Sizes of projects come from the braces of the texts, without Python; a project over the window's bound gets the same numbers."""
    from pathmine.operators import numbering as N

    text = "\nint f(int a) { if (a) { return 1; } return 2; }\n// int no(int a) {\nint g(int a) { return a; }\n"
    files = spark.createDataFrame([(f"p{i % 2}", f"{i}.c", text if i else None) for i in range(6)], "project string, path string, content string")
    want = sorted(map(tuple, PP.preprocess(files, 3072).collect()))
    assert [r[:2] for r in want] == [("p0", i) for i in range(4)] + [("p1", i) for i in range(6)]
    with monkeypatch.context() as m:
        m.setattr(PP, "number_per_project", lambda f, n: N.number_within(f, ["project"], ["path", "pos"], "fn_id", bounded=False, window_rows=1, at_most=n))
        assert sorted(map(tuple, PP.preprocess(files, 3072).collect())) == want

    def refuse(batches):
        raise AssertionError("scanned")
        yield

    monkeypatch.setattr(PP, "extract_functions", lambda f: f.mapInPandas(refuse, PP.FUNCTION_SCHEMA))
    PP.preprocess(files, 3072)  # builds the plan: nothing is scanned yet


def test_dumps_are_parsed_once(spark):
    """Graphs, nodes and edges of a dump are read from what one scan of the texts wrote; dumps without statements keep their graph."""
    dumps = spark.createDataFrame([("a", 'digraph "f" { "1" [label = "(METHOD,f)"]; "2" [label = "(X,y)"]; "1" -> "2" }'), ("b", "digraph g { }"), ("c", ""), ("d", None)],
                                  "graph_id string, dot string")
    tables = DOT.parse_dot(dumps)
    for t in tables:
        plan = t._jdf.queryExecution().optimizedPlan().toString()
        assert "Relation" in plan and "regexp_extract_all(dot" not in plan and "regexp_replace(dot" not in plan
    g, n, e = tables
    assert sorted((r.graph_id, r.name) for r in g.collect()) == [("a", "f"), ("b", "g"), ("c", ""), ("d", "")]
    assert sorted((r.node_id, r.type, r.token) for r in n.collect()) == [("1", "METHOD", "f"), ("2", "X", "y")]
    assert [(r.graph_id, r.src, r.dst, r.label) for r in e.collect()] == [("a", "1", "2", None)]
