"""The conversation trie against a brute-force trie, on planted rows and on long and repeated conversations."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import types as T

from flintglass.llm import conversation_trie
from flintglass.llm.registry import ORACLE_SQL, QUERIES

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("conv_id", T.LongType()), ("turn", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("depth", T.StringType()), ("owner", T.StringType()))])
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            text = text or ""
            own[c].append(((turn is not None, turn or 0, role or "", hashlib.sha256(text.encode()).digest()), (role or "", text)))
    own = {c: [t for _, t in sorted(v)] for c, v in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        ends[whole].append(c)
        for d in range(len(whole) + 1):
            members[whole[:d]].append(c)
    kids = defaultdict(list)
    for q in members:
        if q:
            kids[q[:-1]].append(q)

    out = []
    for q in members:
        saved = leaves = 0
        stack = [q]
        while stack:
            x = stack.pop()
            saved += (len(members[x]) - 1) * len(x[-1][1]) if x else 0
            leaves += not kids[x]
            stack += kids[x]
        listed = ",".join(map(str, sorted(ends[q])))
        out.append((min(members[q]), len(q), min(members[q[:-1]]) if q else None, len(members[q]), len(kids[q]), leaves, saved, hashlib.sha256(listed.encode()).hexdigest()))
    return sorted(out, key=repr)


def planted():
    rows = [(None, 0, "user", "lost"), (7, None, None, None), (7, None, "user", "b"), (7, 1, "user", "b"), (7, 1, "user", "a")]
    for c in range(200, 260):  # many equal rebuilt conversations, some ending inside others
        rows += [(c, k, "user" if k % 2 == 0 else "bot", f"turn {k}") for k in range(3 + c % 4)]
    rows += [(c, k, "user", f"own {k}") for c in range(300, 330) for k in range(c % 7)]  # the base has no turns
    rows += [(1000, k, "user", "é" * (k % 3)) for k in range(90)] + [(1000, 5, "user", "é")] * 3
    rows += [(c, k, "user", "é" * (k % 3)) for c in (1001, 1002, 1003) for k in range(40 + c % 3)]
    return rows + [(c, 0, "user", "only") for c in (401, 402, 403, 404, 405)]


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


@pytest.mark.parametrize("segment,chunk", [(65_536, 8_192), (4, 2)])
def test_planted_rows(spark, monkeypatch, segment, chunk):
    monkeypatch.setattr(conversation_trie, "SEGMENT", segment)
    monkeypatch.setattr(conversation_trie, "CHUNK", chunk)
    rows = planted()
    given = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    assert got(conversation_trie.trie(given)) == brute(rows)


def test_empty_table(spark):
    assert conversation_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0


def test_sql_on_planted_rows(spark, tmp_path):
    rows = planted()
    spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op12_conversation_trie']})").fetchall(), key=repr) == brute(rows)
    assert got(QUERIES["op12_conversation_trie"](spark, str(tmp_path))) == brute(rows)
