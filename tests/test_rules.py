"""Signature tables and rule tables."""

import random

import pytest

from flintglass.operators import content, rules


def test_literals():
    cases = {r"RIFF.{4}AVI LIST": "AVI LIST", r"BM.{4}\x00\x00\x00\x00": "BM", r"\x7FELF": "\x7fELF", r"ab?c": None, r"abc?d": "ab", r"[ab]xyz": "xyz", r"(ab|cd)": None, r"a|bcd": None, r"%PDF": "%PDF", r"\d+abc\.e": "abc.e", r"x{2}yz": "yz", "a": None, r"PK\x03\x04": "PK\x03\x04"}
    assert {p: rules.longest_literal(p) for p in cases} == cases


def test_a_user_adds_a_row(spark):
    table = rules.signature_rules(spark, content.SIGNATURES)
    own = spark.createDataFrame([(100, "own", "MAG[I1]C", "END", "own", "Other"), (101, "own", "OTHER", None, "own", "Other"), (102, "dots", ".Z", None, "z", "Other")], rules.SIGNATURE_COLUMNS)
    values = [(1, b"..MAGIC a END MAG1C b END x"), (2, b"MAGIC without"), (3, b"OTHER to the end \x00\xff"), (4, None), (5, b""), (6, b"\x89PNG\r\n\x1a\nabcIEND\xae\x42\x60\x82.PK\x03\x04zip"), (7, b"no file")]
    found = content.carve(spark.createDataFrame(values, "id int, data binary"), "data", table.unionByName(own), keep=["id"])
    assert found.columns == ["id", "format", "category", "ext", "number", "carved"]
    got = sorted((r.id, r.format, r.number, bytes(r.carved)) for r in found.collect())
    assert got == [
        (1, "own", 1, b"MAGIC a END"), (1, "own", 2, b"MAG1C b END"), (3, "own", 1, b"OTHER to the end \x00\xff"),
        (6, "png", 1, b"\x89PNG\r\n\x1a\nabcIEND\xae\x42\x60\x82"), (6, "zip", 1, b"PK\x03\x04zip"),
    ]
    z = content.carve(spark.createDataFrame([(1, b"aZb", "x")], "id int, data binary, `a.b` string"), "data", own)
    assert [(r.format, bytes(r.carved), r["a.b"]) for r in z.collect()] == [("dots", b"aZb", "x")]


@pytest.mark.parametrize("row", [(1, None, "a", None, "", ""), (1, "x", None, None, "", ""), (1, "x", "(", None, "", ""), (1, "x", "a*", None, "", ""), (1, "x", "日", None, "", ""), (1, "x", "ab", "(c)", "", "")])
def test_bad_rules_are_named(spark, row):
    with pytest.raises(ValueError, match="signature rule"):
        rules.compiled(spark.createDataFrame([row], rules.SIGNATURE_COLUMNS))


def brute(docs, table):
    return sorted((k, n, sorted(t or [])) for k, text in docs for n, t, p in table if text and p and p in text)


@pytest.mark.parametrize("most_bytes", [16_000_000, 40])
def test_rule_table(spark, most_bytes):
    rng = random.Random(2)
    words = ["alpha", "beta", "é日", "x", "long pattern with spaces", "long pattern with commas", "aaaa", "aaaaaaaaaaaa"]
    docs = [(i % 9, " ".join(rng.choices(words, k=rng.randrange(6)))) for i in range(60)] + [(None, "alpha"), (3, None), (3, ""), (4, "a" * 50_000), (4, "aaaaaaaaaaa")]
    table = [("one", ["t", "u"], "alpha"), ("one", ["t"], "alpha"), ("two", None, "é日 x"), ("short", [], "x"), ("twelve", ["n"], "aaaaaaaaaaaa"), ("none", [], ""), ("null", [], None), ("late", ["l"], "pattern with commas"), (None, ["z"], "beta a")]
    found = rules.rule_matches(spark.createDataFrame(docs, "k int, text string"), "k", "text", spark.createDataFrame(table, "name string, tags array<string>, pattern string"), most_bytes)
    assert sorted(((r.k, r.rule, sorted(r.tags)) for r in found.collect()), key=repr) == sorted(((k, n, sorted(t or [])) for k, text in docs for n, t, p in table if text and p and p in text), key=repr)
    assert rules.rule_matches(spark.createDataFrame(docs, "k int, text string"), "k", "text", spark.createDataFrame([], "name string, tags array<string>, pattern string")).count() == 0


def test_a_hundred_thousand_rules(spark):
    table = spark.range(100_000).selectExpr("concat('r', id) AS name", "array(concat('t', id % 7)) AS tags", "concat('common opening of all rules, then number ', id, ';') AS pattern")
    docs = spark.range(2_000).selectExpr("id AS k", "concat('some text. common opening of all rules, then number ', id * 60, '; and common opening of all rules, then number x') AS text")
    found = rules.rule_matches(docs, "k", "text", table).collect()
    assert sorted((r.k, r.rule, r.tags[0]) for r in found) == sorted((k, f"r{60 * k}", f"t{60 * k % 7}") for k in range(2_000) if 60 * k < 100_000)


def test_a_joined_table_of_rules_stays_off_the_driver(spark, monkeypatch):
    reached = []
    frame = type(spark.range(0))
    for name, columns in (("collect", lambda rows: rows[0].__fields__ if rows else []), ("toArrow", lambda t: t.column_names)):
        monkeypatch.setattr(frame, name, lambda self, f=getattr(frame, name), c=columns: reached.append((set(c(out := f(self))), len(out))) or out)
    table = spark.range(60_000).selectExpr("concat('r', id) AS name", "array('t') AS tags", "lpad(CAST(id AS STRING), 9, '0') AS pattern")
    docs = spark.range(500).selectExpr("id AS k", "concat('Order of ', lpad(CAST(id * 150 AS STRING), 9, '0'), '.') AS text")
    found = rules.rule_matches(docs, "k", "text", table)
    assert not any("pattern" in columns or "name" in columns for columns, _ in reached)  # only counts and bits
    monkeypatch.undo()
    assert sorted((r.k, r.rule, r.tags) for r in found.collect()) == [(k, f"r{150 * k}", ["t"]) for k in range(400)]


@pytest.mark.parametrize("bits", [10, 27])
def test_joined_patterns_of_all_lengths(spark, monkeypatch, bits):
    monkeypatch.setattr(rules, "_MAP_BITS", bits)  # few bits: almost all grams seem to be known
    monkeypatch.setattr(rules, "_LOOKED_UP", 5_000)
    rng = random.Random(4)
    letters = ["a", "b", "é", "日", " "]
    texts = ["".join(rng.choices(letters, k=rng.choice((0, 3, 9, 60, 900, 6_000)))) for _ in range(120)] + ["ab" * 3_000, "x" * 2_000 + "seldom word" + "y" * 2_000 + "seldom wore"]
    cuts = [(t, rng.randrange(len(t)), rng.choice((1, 2, 7, 8, 9, 63, 64, 65, 300, 5_000))) for t in texts * 2 if t]
    patterns = [t[i : i + n] for t, i, n in cuts] + ["seldom word", "seldom wore", "seldom wors", "abababab", "a" * 64 + "b", "\0", "xseldom", "x\0y"]
    table = [(f"r{i}", [str(i)] if i % 3 else None, p) for i, p in enumerate(patterns)]
    docs = [(i % 50 or None, t) for i, t in enumerate(texts)]
    found = rules.rule_matches(spark.createDataFrame(docs, "k int, text string"), "k", "text", spark.createDataFrame(table, "name string, tags array<string>, pattern string"), 0)
    assert sorted(((r.k, r.rule, r.tags) for r in found.collect()), key=repr) == sorted(((k, n, t or []) for k, text in docs for n, t, p in table if p in text), key=repr)
