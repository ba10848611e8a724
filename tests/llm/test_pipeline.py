"""The pipeline's stages against brute-force versions, on the smallest tables and on rows made to be hard."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from flintglass.llm import line_crf, secret_cnn
from flintglass.llm.registry import default_tokenizer
from flintglass.llm.textops import table

SF = "/root/testdata/sf0.001"
KINDS = "doc_id long, text string, lang string, source string, n_chars long, kept string, _q_kept string, comp string"


def prose(name, n=80):
    return " ".join(f"{name}{i} is here." for i in range(n))


A, B, C = prose("alpha"), prose("beta"), prose("gamma")
HARD = [
    (1, A), (5, A), (5, B), (6, A.replace("alpha7 ", "other ")), (None, B), (None, C), (None, C), (8, C + " more words"), (9, None), (9, ""), (10, " \t\n"), (10, " \t\n"),
    (11, prose("delta") + ' token = "abcdef0123456789abcdef01" end'), (11, prose("delta") + ' token = "abcdef0123456789abcdef01" end'), (12, "x" * 50_000), (13, prose("eps", 3_000)),
]


@pytest.fixture(scope="module")
def hard(spark):
    rows = [(d, t, "en", "s", len(t or ""), "x", "y", "z") for d, t in HARD]
    return spark.createDataFrame(rows, KINDS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def one_of_each(rows, ngram=5, percent=80):
    """(doc_id, text) of the rows that stay, pair by pair."""
    sets = []
    for _, text in rows:
        w = words_of(text)
        sets.append({tuple(w[i : i + ngram]) for i in range(max(1, len(w) - ngram + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    return sets, list(groups.values())


def test_near_duplicates_keep_one_row_of_each_group(spark, hard):
    kept = P.near_duplicates(spark, hard, SF)
    assert kept.columns == hard.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    sets, groups = one_of_each(HARD)
    for members in groups:
        rows = [HARD[i] for i in members]
        if not sets[members[0]]:
            assert all(got[r] == HARD.count(r) for r in rows)
            continue
        assert sum(1 for r in set(rows) if got[r]) == 1 and sum(got[r] for r in set(rows)) == 1, rows
        ids = [d for d, _ in rows if d is not None]
        assert next(r for r in set(rows) if got[r])[0] == (min(ids) if ids else None)
    assert sum(got.values()) == len(groups)  # rows without words are groups of their own
    assert got[(5, B)] == 1 and got[(1, A)] == 1 and got[(5, A)] == 0, "another text under the same doc_id stays"


def test_stages_pass_extra_columns_and_empty_tables(spark, hard):
    for name, stage in P.STAGES[:-1]:
        left = stage(spark, hard, SF)
        assert left.columns == hard.columns and left.select("kept", "_q_kept", "comp").distinct().collect() in ([], [("x", "y", "z")]), name
        assert stage(spark, hard.limit(0), SF).count() == 0, name
    assert P.pack(spark, hard.limit(0), SF).count() == 0


def test_secrets_stage(spark, hard):
    clean = P.secrets(spark, hard, SF).collect()
    net = secret_cnn.fit(hard)
    want = Counter((d, secret_cnn.redacted(t, *secret_cnn.scan_text(t, net))) for d, t in HARD)
    assert Counter((r.doc_id, r.text) for r in clean) == want
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in clean) and not any("abcdef0123456789" in (r.text or "") for r in clean)


def test_whole_run_equals_brute_force(spark, tmp_path):
    given = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    passage = bench.filter("text IS NOT NULL").orderBy(F.desc(F.length("text"))).first().text
    extra = [(90_000 + i, t, "en", "s", len(t)) for i, t in enumerate((A, B, A, prose("leak") + " " + passage, C.replace("gamma40 is", "password = hunter2hunter2x. gamma40 is")))]
    docs = given.unionByName(spark.createDataFrame(extra, given.schema))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    found = P.run(spark, sf).collect()

    docs = table(spark, sf, "documents")
    field = line_crf.fit(docs, table(spark, sf, "labels"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    good = [r for r in rows if line_crf.describe(r[1], field, line_crf.WordHasher())[6]]
    _, groups = one_of_each(good)
    single = [min((good[i] for i in g), key=lambda r: r[0]) for g in groups]
    alnum = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 10]) for r in bench.collect() if (w := alnum(r.text)) for i in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}
    pure = [r for r in single if not any(tuple(w[i : i + k]) in windows for w in [alnum(r[1])] for k in sizes for i in range(len(w) - k + 1))]
    assert {90_000, 90_001, 90_004} <= {d for d, _ in pure} and not {90_002, 90_003} & {d for d, _ in pure}
    net = secret_cnn.fit(spark.createDataFrame(pure, "doc_id long, text string"))
    final = [(d, secret_cnn.redacted(t, *secret_cnn.scan_text(t, net))) for d, t in pure]
    assert "hunter2" not in dict(final)[90_004] and "[secret]" in dict(final)[90_004]

    from tokenizers import Tokenizer

    model = Tokenizer.from_file(default_tokenizer())
    want = []
    for d, t in final:
        ids = [*model.encode(t, add_special_tokens=False).ids, 1]
        want += [(d, k, s, len(part := ids[s : s + 4096]), zlib.crc32(np.array(part, "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(want)


@pytest.mark.parametrize("stage", [P.quality, P.near_duplicates, P.decontamination, P.secrets])
def test_columns_of_any_name_pass_through(spark, hard, stage):
    odd = hard.toDF(*hard.columns[:5], "a.b", "c`d", "A B")
    found = stage(spark, odd, SF)
    assert found.columns == odd.columns and found.dtypes == odd.dtypes
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, stage(spark, hard, SF).collect()))


def test_run_gives_the_batch_setting_back(spark):
    before = spark.conf.get(P.BATCH_SETTING)
    spark.conf.set(P.BATCH_SETTING, 777)
    try:
        P.small_batches(spark)
        assert spark.conf.get(P.BATCH_SETTING) == "777"
        spark.conf.set(P.BATCH_SETTING, 12_345)
        assert P.run(spark, SF).count() > 0 and spark.conf.get(P.BATCH_SETTING) == "12345"
    finally:
        spark.conf.set(P.BATCH_SETTING, before)
