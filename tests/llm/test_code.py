"""Source filters and function-documentation pairs."""

from datetime import datetime

import pytest
from conftest import rows

from codeweft.llm import codefilter, docpairs
from codeweft.llm.islands import functions

HAND = "package a\n\n// Retries three times, then gives up.\nfunc run() {\n\tgo()\n}\n"
LIB = "/*!\n * quickpad v1.2.3\n * (c) 2015 the quickpad contributors, MIT licensed\n */\n" + "".join(f"function pad{i}(text) {{ return text + other{i * 7}; }}\n" for i in range(12))


def kinds(spark, *files):
    df = spark.createDataFrame(files, "rel_path string, content string").selectExpr("*", "1 as kind", "2 as n", "3 as h")
    return dict(rows(codefilter.not_hand_written(df)))


def test_generated(spark):
    got = kinds(
        spark,
        ("r/a.go", "// Code generated by tool v1. DO NOT EDIT.\npackage a\n"),
        ("r/b.py", "#!/usr/bin/env python\n# Copyright 2020 X\n\n# <auto-generated>\n#   Changes are lost when tool runs again.\n# </auto-generated>\nx = 1\n"),
        ("r/c.ts", "// Diese Datei wurde automatisch erzeugt. Nicht von Hand bearbeiten.\r\nexport const a = 1;\r\n"),
        ("r/d.php", "<?php\n/*\n * Generated by the x compiler.\n * Do not edit by hand!\n */\nclass A {}\n"),
        ("r/e.rs", "pub const A: u32 = 1;\n\n// @generated SignedSource<<12>>\n"),
        ("r/pkg/x.pb.go", "package x\nfunc (a *B) C() string {\n\treturn a.C\n}\n"),
        ("r/generated/y.ts", "export class A {\n    b() { return this.c[1]; }\n}\n"),
        ("r/no1.go", '// Not generated: edit freely.\n' + HAND),
        ("r/no2.go", "// This used to be generated by a tool and is now maintained by hand.\n" + HAND),
        ("r/no3.go", HAND + '\nconst header = "// Code generated by %s. DO NOT EDIT."\n'),
        ("r/generated_x.go", HAND),
        ("r/z.gen.go", HAND),
        ("r/generators/x.go", HAND),
        ("r/package-lock.json", None),
    )
    assert got == {f"r/{p}": "generated" for p in ("a.go", "b.py", "c.ts", "d.php", "e.rs", "pkg/x.pb.go", "generated/y.ts", "package-lock.json")}


def test_notices_count_where_they_are_stated(spark):
    lead = "// {}\n"
    yes = ["Code generated by stringer. DO NOT EDIT.\n// The template lives elsewhere.", "Code generated by x. DO NOT EDIT. Hand-written helpers are in util.go.", "Warning: this file is automatically generated.", "Attention! Auto-generated by y from z.", "The contents were generated by a tool.\n// Do not modify them.", "Ce fichier a été généré automatiquement."]
    no = ["Parses code generated by protoc.", "Tests for automatically generated ids.", "This file is not automatically generated, it is maintained by hand.", "Changes to what was generated by the planner are merged here.", "Once automatically generated, now hand-written."]
    got = kinds(spark, *[(f"r/y{i}.go", lead.format(t) + HAND) for i, t in enumerate(yes)], *[(f"r/n{i}.go", lead.format(t) + HAND) for i, t in enumerate(no)])
    assert got == {f"r/y{i}.go": "generated" for i in range(len(yes))}


def test_small_files(spark):
    small = 'export const TABLE = ["aaaaaaaaaa", "bbbbbbbbbb", 12, 13, "cccccccccc", "dddddddd"];\n'
    doc = '"""What this package does, in a long sentence that is no data at all."""\n'
    lib = "export function padLeft(text, size) {\n  return text.padStart(size);\n}\n"
    got = kinds(spark, ("r/t.js", small), ("r/__init__.py", doc), ("r/node_modules/pad/i.js", lib), ("r/src/p.js", lib), ("r/src/q.js", lib.replace("padLeft", "own").replace("padStart", "trim")))
    assert got == {"r/t.js": "data", "r/node_modules/pad/i.js": "vendored", "r/src/p.js": "vendored"}


def test_minified_and_data(spark):
    code = "".join(f'function a{i}(b){{return b.c{i}(d)}}if(e&&!f)throw new Error("x");' for i in range(40))
    long_comment = "// pattern: " + "|".join(f"word{i}" for i in range(200)) + "\n" + HAND
    got = kinds(
        spark, ("r/x.js", code), ("r/y.min.js", "/*! y v1.0.0 */\n" + code), ("r/z.min.go", HAND), ("r/w.go", long_comment),
        ("r/d.py", "T = [\n" + "".join(f'    "W{i}abc", 0x{i:04x},\n' for i in range(80)) + "]\n"), ("r/k_data.go", HAND), ("r/e.go", ""), ("r/n.go", None), (None, code),
    )
    assert got == {"r/x.js": "minified", "r/y.min.js": "minified", "r/d.py": "data"}


def test_vendored(spark):
    lines = LIB.split("\n")[4:]
    copy = "\n".join([*lines[:5], "function padNew(text) { return text; }", *lines[5:]])
    got = kinds(spark, ("r/node_modules/quickpad/a.js", LIB), ("s/lib/quickpad.js", LIB), ("t/util/text.js", copy), ("t/util/part.js", "\n".join(lines[:4] + [f"function own{i}() {{ return {i}; }}" for i in range(30)])), ("t/vendors/x.go", HAND), ("u/vendor/n.go", None))
    assert got == {p: "vendored" for p in ("r/node_modules/quickpad/a.js", "s/lib/quickpad.js", "t/util/text.js", "u/vendor/n.go")}


@pytest.mark.parametrize("most", [0, 10**6])
def test_lines_of_several_libraries_make_no_copy(spark, monkeypatch, most):
    monkeypatch.setattr(codefilter, "BROADCAST_ROWS", most)
    lines = [f"if (state{i} !== expected{i}) return;" for i in range(12)]
    libraries = [(f"r/node_modules/lib{k}/a.js", "\n".join([*lines[k : k + 2], *(f"function own{k}_{i}() {{ go(); }}" for i in range(9))])) for k in range(0, 12, 2)]
    header = [f"import {{ part{i} }} from './part{i}';" for i in range(4)]
    many = [(f"r/node_modules/all{k}/a.js", "\n".join([*header, f"function only{k}() {{ go(); }}"])) for k in range(30)]
    copy = ("t/src/copy.js", "\n".join([*header, libraries[0][1]]))
    got = kinds(spark, *libraries, *many, copy, ("t/src/hand.js", "\n".join(lines)), ("t/src/short.js", "\n".join([*header, *lines[:4]])))
    assert got == {p: "vendored" for p, _ in [*libraries, *many, copy]}


@pytest.mark.parametrize("most", [0, 10**6])
def test_copies_of_what_very_many_libraries_hold(spark, monkeypatch, most):
    monkeypatch.setattr(codefilter, "BROADCAST_ROWS", most)
    part = [f"export function shim{i}(target) {{ return target.shim{i}; }}" for i in range(12)]
    header = [f"import {{ piece{i} }} from './piece{i}';" for i in range(6)]
    many = [(f"r/node_modules/lib{k}/shim.js", "\n".join(part)) for k in range(25)]
    large = [(f"r/node_modules/lib{k}/main.js", "\n".join([*header, *(f"function main{k}_{i}() {{ go(); }}" for i in range(20))])) for k in range(25)]
    copies = [("t/src/shim.js", "\n".join(part)), ("t/src/again.js", "\n".join(part)), ("t/src/changed.js", "\n".join([*part[:5], "export function added(target) { return 1; }", *part[6:]]))]
    hand = [("t/src/index.js", "\n".join(header)), ("t/src/short.js", "\n".join([*header, "const started = begin(piece0, piece1);"])), ("t/src/half.js", "\n".join([*part[:6], *(f"function own{i}() {{ rest(); }}" for i in range(6))]))]
    assert kinds(spark, *many, *large, *copies, *hand) == {p: "vendored" for p, _ in [*many, *large, *copies]}


def test_rescanned_and_empty_tables(spark):
    assert kinds(spark, ("r/x.go", "// Code generated by t. DO NOT EDIT.\n"), ("r/x.go", "// Code generated by t. DO NOT EDIT.\n"), ("r/x.go", None)) == {"r/x.go": "generated"}
    assert codefilter.not_hand_written(spark.createDataFrame([], "rel_path string, content string")).count() == 0


def found(path, text):
    return [(line, name, doc) for line, name, _, doc, _ in functions(path, text)]


def test_islands():
    ts = "/** Adds. */\n@Dec()\nexport function add(a: number) {\n  return a + '}';\n}\n\n/** Gone */\n\nfunction b() { if (x) { y(); } }\nclass C {\n  /**\n   * Two\n   * lines.\n   */\n  run(): void;\n  /* plain */\n  go(x) { return x; }\n}\n/** One. */ const f = (x) => x + 1;\n"
    assert found("a.ts", ts) == [(3, "add", "Adds."), (19, "f", "One.")]
    py = "def a(x,\n      y):\n    '''Doc\n    more.\n    '''\n    return 1\n\ndef b():\n    x = 1\n\ndef c(): pass\nasync def d(self):\n\n    'late'\n"
    assert found("a.py", py) == [(1, "a", "Doc\nmore."), (8, "b", ""), (11, "c", ""), (12, "d", "")]
    rs = "/// Does it.\n/// Well.\n#[inline]\npub fn a(x: &str) -> u8 {\n  'x'; \"}\"\n}\n// no\nfn b() {}\ntrait T { }\n/// x\nfn c();\n"
    assert found("a.rs", rs) == [(4, "a", "Does it.\nWell.")]
    php = "<?php\r\n/**\r\n * Says.\r\n */\r\n#[Pure]\r\npublic function a($x) {\r\n  return \"}\";\r\n}\r\n"
    assert found("a.php", php) == [(6, "a", "Says.")]
    assert next(iter(functions("a.rs", rs)))[4] == "{\n  'x'; \"}\"\n}"
    assert list(functions("a.md", "x")) == []


def test_long_annotations_and_signatures():
    block = "@Operation(\n  responses = {\n" + "".join(f'    @ApiResponse(code = "{i}"),\n' for i in range(40)) + "\n  }\n)\n"
    java = "class A {\n/** Keeps the order. */\n" + block + "public void run() {\n  go();\n}\n}\n"
    assert ("run", "Keeps the order.") in [(name, doc) for _, name, doc in found("A.java", java)]
    py = "def run(\n" + "".join(f"    a{i},\n" for i in range(300)) + "):\n    'Keeps the order.'\n    return 1\n"
    assert found("a.py", py) == [(1, "run", "Keeps the order.")]
    many = "".join(f"x{i} = [\n" for i in range(3)) + "def broken(\n" * 3 + "y = 1\n"
    assert found("b.py", many) == []


def body(path, text):
    return {name: body for _, name, _, _, body in functions(path, text)}


def test_bodies_end_where_their_brackets_do():
    doc = "/** Says. */\n"
    js = doc + "function cut(s) {\n  return s.split(/[\"{]/).map((x) => x / 2 / 3);\n}\n" + doc + "function next() { return `a ${b({c: `}`})} }`; }\n"
    assert body("a.js", js) == {"cut": '{\n  return s.split(/["{]/).map((x) => x / 2 / 3);\n}', "next": "{ return `a ${b({c: `}`})} }`; }"}
    rs = "/// Says.\nfn a() -> &str {\n  r#\"}\" {\"# /* } /* } */ } */\n}\n/// Says.\nfn b<'a>(x: &'a str)\nwhere\n  T: A,\n{ '}' }\n"
    assert body("a.rs", rs) == {"a": '{\n  r#"}" {"# /* } /* } */ } */\n}', "b": "{ '}' }"}
    php = "<?php\n" + doc + "function a() {\n  return <<<TXT\n  } it's {\n  TXT . 'x\n}'; # it's }\n}\n" + doc + "function b() { return 1; }\n"
    assert body("a.php", php) == {"a": "{\n  return <<<TXT\n  } it's {\n  TXT . 'x\n}'; # it's }\n}", "b": "{ return 1; }"}
    java = "class A {\n" + doc + 'String a()\n    throws B, C {\n  return """\n  } "{" """;\n}\n' + doc + "abstract int b();\nint c;\nvoid d() { }\n}\n"
    assert body("A.java", java) == {"a": '{\n  return """\n  } "{" """;\n}'}
    ts = doc + "export const a = 1\nfunction other() { }\n" + doc + "export function b(x: { y: string }): { z: number } {\n  return x\n}\n" + doc + "const c = async (x) =>\n  x.y()\nconst d = 2\n" + doc + "const e = function () { go() }\n"
    assert body("a.ts", ts) == {"b": "{\n  return x\n}", "c": "x.y()", "e": "{ go() }"}


def test_islands_are_read_in_linear_time():
    import time

    def seconds(n):
        text = "".join(f"/** Says. */\nconst a{i} = [1]\nrun({i})\n)\n*/\n" for i in range(n)) + "".join(f"def f{i}(\n" for i in range(n))
        began = time.process_time()
        list(functions("a.ts", text)), list(functions("a.py", text))
        return time.process_time() - began

    seconds(200)
    assert seconds(8000) < 8 * 4 * max(seconds(1000), 0.02)


def test_informative(spark):
    no = ["", None, "  ", "----", "TODO: later", "FIXME", "N/A", "run.", "Run runs.", "Runs it.", "Helper to run.", "run helper", "@param x\n@return", "@inheritDoc", "{@inheritDoc}", "@author team", "@since 1.2", "eslint-disable-next-line no-shadow", "nolint:errcheck", "pragma: no cover", "noqa: E501", "go:noinline", "@ts-ignore", "Copyright (c) 2020 The Authors. All rights reserved.", "Created by ide on 2020-1-2.", "func run(x string) error", "x = run(y)\nreturn x;", "Description of run", "ditto", "See below", "Auto-generated method stub"]
    yes = ["Times are in UTC.", "Blocks until the queue is empty.", "run stops early.", "返回新的副本，找不到时返回空值。", "TODO: more\nKeeps order.", "@param x the widest ledger", "Devuelve la ruta parcial.", "@deprecated use the other one"]
    df = spark.createDataFrame([(d,) for d in no + yes], "d string").selectExpr("d", "'run' as name", "'func run(x string)' as s")
    got = {r.d: r.ok for r in df.withColumn("ok", docpairs.informative(df.d, df.name, df.s)).collect()}
    assert [d for d in no if got[d]] == [] and [d for d in yes if not got[d]] == []
    verbs = spark.createDataFrame([("tally_batch", "tally_batch tallys batch."), ("copyPath", "Copies the path."), ("copyPath", "Copies the path lazily.")], "name string, d string")
    assert [r.ok for r in verbs.select(docpairs.informative(verbs.d, verbs.name, verbs.name).alias("ok")).collect()] == [False, False, True]


def test_prose_that_begins_like_a_directive_or_code(spark):
    no = ["TODO: later", "todo doc", "XXX add docs", "Hack: swap later", "go:noinline", "go:build linux && amd64", "+build linux,!cgo", "#region helpers", "eslint-disable-next-line no-shadow", "eslint-disable no-shadow, max-len -- legacy", "nolint:errcheck", "nolint:errcheck // legacy", "noqa: E501", "pylint: disable=too-many-args", "type: ignore[attr]", "pragma: no cover", "phpcs:ignore", "phpcs:ignore Foo.Bar", "@ts-ignore", "@phpstan-ignore-next-line", "clang-format off", "istanbul ignore next", "noinspection unused", "Created by ide on 2024-06-10.", "Author: Jane Doe <j@x.org>", "Written by Ada Lovelace.", "@author team", "@since 1.2", "Since 1.2", "Version: 2.0.1", "Date: 2020-01-02", "Copyright (c) 2021 The Edge Authors. All rights reserved.", "Copyright The Kubernetes Authors.", "SPDX-License-Identifier: MIT", "Licensed under the Apache License, Version 2.0.", "License: MIT", "MIT License", "return digest;", "payload = flush_cursor(parcel)", "const x = \"two words\";", "run(path)", "func zqx(x string) error", "def zqx(a, b) -> int:", "import os.path;", "if (x) {", "for (int i = 0; i < n; i++) {", "}", "private String owner;", "Ledger ledger = make(token);", "@see mergeShard", "@override", "{@inheritDoc}", "No documentation.", "Missing documentation", "Add description here", "Auto-generated method stub", "self-explanatory", ">>> zqx(3)", "public function go($x) {"]
    yes = ["Build the index from the shards of a repository.", "Return the offset (in bytes) of the first match.", "Import rows (without headers) from the ledger.", "Let callers wait: wakes them in order.", "Date of the last delivery in local time.", "Version of the schema that the peer speaks.", "Since peers may lag, waits for two heartbeats.", "Contact points of a cluster (seed nodes).", "Region of the last delivery.", "Prettier output is cached by path.", "Lint results of a run, by severity.", "Type: the kind of edge that is followed.", "Owner of the lease, or null.", "Author: the user that pushed the commit.", "License keys expire after a year.", "Copyright notices are kept at the top.", "Released under memory pressure before the next batch.", "This function is distributed over all workers.", "Todo items are sorted by due date.", "Hack around a slow disk.", "Function stub that forwards to the remote peer.", "Missing documentation is reported as a warning.", "Write documentation comments to the output.", "Closes the channel early;", "Waits for locks;", "The state is one of {open, closed}", "depth = number of links up to the root", "Class of service (gold, silver) that a parcel has.", "Public keys: one for each peer.", "Static files; served from the cache.", "Package sizes (in bytes) by name.", "@internal Only the scheduler may drop leases.", "... and then drops the lease.", "Created by the scheduler when a lease runs out.", "Generated by the planner for each shard.", "Sonar pings are sent twice.", "Var args (and keyword args) are merged.", "Const folding: leaves calls alone.", "const folding (of literals) is skipped", "return the offset (in bytes) of the first match", "build the index from shards", "version of the schema that peers speak", "Maintained by a background thread.", "Modified by peers at any time.", "See code owners: they approve.", "Wip limits are per lane.", "Idempotent;", "owners of the lease (by shard)"]
    df = spark.createDataFrame([(d,) for d in no + yes], "d string").selectExpr("d", "'zqx' as name", "'zqx' as s")
    got = {r.d: r.ok for r in df.withColumn("ok", docpairs.informative(df.d, df.name, df.s)).collect()}
    assert [d for d in no if got[d]] == [] and [d for d in yes if not got[d]] == []


def test_pairs(spark):
    sym = "symbol_id long, file_path string, name string, kind string, signature string, documentation string, body string, start_line int, line int"
    data = [
        (1, "r/a.go", "f", " Function", "func f()", "Keeps the order.", "{ }", 3, 0), (2, "r/a.go", "g", "method", "func g()", "Keeps the order.", None, 5, 0), (3, "r/a.go", "h", "struct", "", "Keeps the order.", "{}", 5, 0),
        (4, "r/b.py", "f", "METHOD", "def f()", None, None, 1, 0), (5, "r/b.py", "g", "method", "def g()", None, None, 4, 0), (6, "r/none.py", "f", "method", "def f()", None, None, 1, 0), (7, None, "f", "method", "", None, None, 1, 0), (8, "r/b.py", "f", None, "", "x", "y", 1, 0),
    ]
    symbols = spark.createDataFrame(data + data[:1] + data[3:4], sym)
    src = 'def f():\n    """Waits for the lock."""\n\ndef g():\n    """TODO"""\n    return 1\n'
    files = spark.createDataFrame([("r/b.py", src, datetime(2024, 1, 1)), ("r/b.py", src, datetime(2024, 1, 2)), ("r/none.py", None, None), (None, "x", None)], "rel_path string, content string, scanned_at timestamp")
    assert rows(docpairs.pairs(symbols, files), "symbol_id", "documentation", "body") == [(1, "Keeps the order.", "{ }"), (4, "Waits for the lock.", '    """Waits for the lock."""')]
    assert rows(docpairs.pairs(symbols, files, with_body=False), "symbol_id") == [(1,), (4,)]
    assert docpairs.pairs(symbols.limit(0), files.limit(0)).count() == 0
