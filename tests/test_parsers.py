import pytest
from conftest import rows
from sources import GO, JAVA, PHP, PYTHON, RUST, TYPESCRIPT

from codeweft.parsers import golang, lines, registry


def files(spark, *pairs):
    return spark.createDataFrame(pairs, "file_path string, content string")


def parsed(spark, parser, path, text):
    symbols, imports, *_ = parser(files(spark, (path, text)))
    found = [r for r in symbols.orderBy("ordinal").collect()]
    return found, [r.imp for r in imports.orderBy("pos").collect()]


def brief(found):
    return [(s.kind, s.qualified_name, s.start_line) for s in found]


def test_python(spark):
    found, imports = parsed(spark, lines.python, "db.py", PYTHON)
    assert imports == ["math", "harbour.tides"]
    assert brief(found) == [("class", "Buoy", 5), ("method", "Buoy.__init__", 7), ("method", "Buoy.drift", 11), ("function", "_signal", 14), ("class", "Anchor", 17), ("method", "Anchor.drop", 18)]
    by = {s.name: s for s in found}
    assert by["Buoy"].signature == "@register\nclass Buoy(Float, Lit):" and by["Buoy"].implements == ["Float", "Lit"] and by["Buoy"].calls == ["Buoy"]
    assert by["drift"].signature == "@staticmethod\nasync def drift(wind: float) -> float" and by["drift"].calls == ["drift"]
    assert [s.name for s in found if not s.exported] == ["__init__", "_signal"]


def test_java(spark):
    found, imports = parsed(spark, lines.java, "A.java", JAVA)
    assert imports == ["java.time.Instant", "java.lang.Math.max", "org.harbour.dock.*"]
    assert brief(found) == [("record", "org.harbour.cargo.Berth", 8), ("class", "org.harbour.cargo.Crane", 12), ("method", "Crane.Crane", 16), ("method", "Crane.lift", 21), ("interface", "org.harbour.cargo.Lifter", 29), ("method", "Lifter.lift", 30), ("enum", "org.harbour.cargo.Weather", 33)]
    crane, lift = found[1], found[3]
    assert crane.signature.startswith('@Component\n@Scope("day")\npublic class Crane') and crane.implements == ["Machine", "Lifter", "Auditable"]
    assert lift.signature == "@Override\npublic void lift(Berth to)" and not found[4].exported


def test_php(spark):
    found, imports = parsed(spark, lines.php, "U.php", PHP)
    assert imports == ["Harbour\\Clock", "Harbour\\Maps\\Chart"]
    assert brief(found) == [("function", "_level", 8), ("class", "Harbour\\Tides\\TideTable", 13), ("method", "TideTable::__construct", 17), ("method", "TideTable::high", 20), ("trait", "Harbour\\Tides\\Logged", 25), ("method", "Logged::log", 26), ("enum", "Harbour\\Tides\\Phase", 30)]
    table = found[1]
    assert table.implements == ["Almanac", "Readable", "Cached", "Logged"] and table.signature.startswith('#[Table("tides")]\n')
    assert [s.name for s in found if not s.exported] == ["_level"] and found[2].signature.startswith("#[Slow]\n")


def test_rust(spark):
    found, imports = parsed(spark, lines.rust, "g.rs", RUST)
    assert imports == ["std::fmt::Display", "crate::rope"]
    assert brief(found) == [("type", "Knot", 4), ("interface", "Tie", 6), ("function", "tie", 7), ("struct", "Rope", 10), ("method", "Rope::splice", 15), ("function", "coil", 20)]
    assert found[5].signature == "pub async fn coil(rope: Rope) -> Rope" and all(s.calls == [] and s.implements == [] for s in found)


def test_typescript(spark):
    found, imports = parsed(spark, lines.typescript, "a.ts", TYPESCRIPT)
    assert imports == ["./charts", "net"]
    assert brief(found) == [("type", "Heading", 4), ("interface", "Vessel", 6), ("function", "steer", 10), ("class", "Pilot", 14), ("method", "Pilot.board", 15), ("type", "Flag", 20), ("function", "moor", 22)]
    by = {s.name: s for s in found}
    assert by["Pilot"].implements == ["Guide", "Vessel", "Paid"] and not by["Flag"].exported
    assert by["steer"].signature.endswith("=>") and by["moor"].calls == ["moor"] and by["moor"].exported


def test_go(spark):
    found, imports = parsed(spark, golang.golang, "lock.go", GO)
    assert imports == ["fmt", "harbour/gate"]
    assert brief(found) == [("struct", "Chamber", 11), ("method", "(Chamber).Level", 15), ("interface", "Filler", 18), ("type", "Depth", 19), ("function", "Raise", 25)]
    raised = found[4]
    assert raised.documentation == "Raise fills a chamber.\n" and raised.body.startswith("{\n\tif err") and raised.body.endswith("}") and raised.exported
    assert raised.calls == ["open", "gate.Upper", "[]rune", "fmt.Errorf", "(&Chamber{}).drain(c).wait", "(&Chamber{}).drain"]
    assert found[0].documentation == "Chamber is filled\nfrom above.\n"


@pytest.mark.parametrize("text", ["package a\nfunc f( {\n}", 'package a\nvar x = "open\n', "func f() {}", "package a\n}"])
def test_go_that_cannot_be_read_is_dropped(spark, text):
    assert rows(golang.golang(files(spark, ("a.go", text)))[2]) == []


def test_registry(spark):
    given = files(spark, ("a.go", GO), ("B.PY", PYTHON), ("c.md", "# x"), ("bad.go", "func"), ("e.ts", ""), ("n.rs", None), (None, "x"), ("a.go", GO))
    symbols, imports, read = registry.parse(given)
    assert rows(read) == [("B.PY",), ("a.go",), ("e.ts",)]
    assert {r.file_path for r in symbols.select("file_path").distinct().collect()} == {"a.go", "B.PY"}
    assert imports.count() == 4
    assert registry.parse(given.limit(0))[0].count() == 0


def test_contents_do_not_move_and_recurring_paths_count_once(spark):
    given = files(spark, ("a.py", PYTHON), ("a.py", PYTHON), ("b.py", PYTHON), ("b.py", "def other(): pass\nimport os\n"), ("c.go", GO), ("c.go", GO))
    symbols, imports = lines.python(given)
    per = {r.file_path: r["count"] for r in symbols.groupBy("file_path").count().collect()}
    assert per["a.py"] == 6 and per["b.py"] in (1, 6) and {r["count"] for r in imports.where("file_path = 'a.py'").groupBy("file_path").count().collect()} == {2}
    assert golang.golang(given.where("file_path = 'c.go'"))[0].count() == 5
    for df in (symbols, imports):
        plan = df._jdf.queryExecution().executedPlan().toString()
        moved = [line for line in plan.split("\n") if "Exchange" in line]
        assert moved and not any("content" in line for line in moved)


def test_long_and_unicode_lines(spark):
    text = "x = '" + "y" * 100_000 + "'\r\n\u00a0def nothing\r\nclass Größe:\n\tdef f(self):\n"
    found, _ = parsed(spark, lines.python, "u.py", text)
    assert brief(found) == [("function", "f", 4)]  # the class's name is not plain ASCII, so no class is open
