"""Every stage of the pipeline against plain Python, with repeated and null ids, odd names and an empty table."""

import itertools
import re
from collections import Counter, defaultdict

import pytest
import public_tokenizers

import corpus_pipeline
from headway.llm import mixture, near_dedup, toxicity
from headway.llm.common import table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _id string, _copy int, _hash int, digest int, kept boolean, _digest string"


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def long(*tags, n=60):
    """A text of its own words, with a few replaced."""
    w = [f"{tags[0]}{i}" for i in range(n)]
    for t in tags[1:]:
        w[int(t)] = f"other{t}"
    return " ".join(w)


@pytest.fixture(scope="module")
def docs(spark):
    a, b, u = long("a"), long("b"), long("u")
    rows = [
        (3, a, "s1"), (5, a, "s1"), (5, b, "s1"), (7, long("b", 59), "s2"), (8, a, "s1"), (8, u, None), (None, a, "s2"),
        (None, "one text without id", "s1"), (None, "one text without id", "s1"), (9, "", "s2"), (9, "", "s2"), (10, None, "s2"),
        (11, " \n", "s1"), (12, "few words", None), (13, "Few Words", None), (13, long("d", n=900), "s2"), (14, long("d", 1, n=900), "s1"),
        (15, long("e"), None), (16, long("e", 0, 59), None), (16, long("e", 0, 59) + " x", None), (17, long("f", 20, 30, 40), "s1"), (17, long("f"), "s1"),
    ]
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", 1, 2, 3, True, "y") for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def model(spark):
    folder = "/root/testdata/sf0.01"
    return toxicity.train(table(spark, folder, "documents"), table(spark, folder, "labels"))


def rows_of(frame):
    return Counter((r.doc_id, r.text, r.source) for r in frame.collect())


def exact(rows):
    """Of equal texts (null: empty) the largest id; ids come before none."""
    best = {}
    for row in rows:
        now = best.get(row[1] or "")
        if now is None or (row[0] is not None, row[0] or 0) > (now[0] is not None, now[0] or 0):
            best[row[1] or ""] = row
    return Counter(best.values())


def near(rows, n=5, percent=80):
    """One row of each group of texts whose shingle sets reach the similarity, by links."""
    rows = list(rows)
    sets = []
    for _, text, _ in rows:
        w = words(text)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for _ in rows:
        for a, b in itertools.combinations(range(len(rows)), 2):
            both = len(sets[a] & sets[b])
            known = sets[a] and sets[b] and rows[a][0] is not None and rows[b][0] is not None
            if known and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                label[a] = label[b] = min(label[a], label[b])
    groups = defaultdict(list)
    for row, g in zip(rows, label, strict=True):
        groups[g].append(row)
    return groups.values()


def test_stages_keep_what_they_should(spark, docs):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "source_mix", "best_fit_packing"]
    stages = dict(corpus_pipeline.STAGES)
    single = stages["exact_dedup"](spark, docs, "")
    assert single.columns == docs.columns
    want = exact([tuple(r) for r in docs.select("doc_id", "text", "source").collect()])
    # an empty text may be a null one
    blank = lambda c: Counter({(i, t or "", s): n for (i, t, s), n in c.items()})
    assert blank(rows_of(single)) == blank(want)

    apart = stages["near_dedup"](spark, single, "")
    assert apart.columns == docs.columns
    groups = near(want)
    left = blank(rows_of(apart))
    for group in groups:
        stay = [r for r in group if left[r[0], r[1] or "", r[2]]]
        assert len(stay) == 1 and left[stay[0][0], stay[0][1] or "", stay[0][2]] == 1
        assert stay[0][0] == (min(r[0] for r in group) if len(group) > 1 else group[0][0])
    assert left.total() == len(groups)
    assert (8, long("u"), None) in left and any(t == long("b") or t == long("b", 59) for _, t, _ in left)

    mixed = stages["source_mix"](spark, apart, "")
    assert mixed.columns == docs.columns and set(blank(rows_of(mixed))) <= set(left)
    targets = {r.source: r.target for r in mixture.mix(apart).collect()}
    taken, longest = Counter(), Counter()
    for r in mixed.collect():
        taken[r.source] += len(words(r.text))
    for (_, t, s), _ in left.items():
        longest[s] = max(longest[s], len(words(t)))
    assert all(abs(taken[s] - targets[s]) <= longest[s] / 2 + 1.5 * mixture.BLOCK for s in targets)

    packed = stages["best_fit_packing"](spark, mixed, "").collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    tokens = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert sum(r.length for r in packed) == tokens and max(r.offset + r.length for r in packed) <= 2048


def test_near_rows_of_one_id(spark):
    """An id with two texts: neither drags the other out."""
    a, b, u = long("a"), long("b"), long("u")
    rows = [(3, a), (5, a), (5, b), (7, long("b", 59)), (8, a), (8, u)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(map(tuple, near_dedup.kept_rows(frame).collect())) == [(3, a), (5, b), (8, u)]
    got = {(r.doc_id, r.component_id) for r in near_dedup.near_duplicates(frame).collect()}
    assert got == {(i, 3) for i in (3, 5, 7, 8)}


def test_toxic_rows_go(docs, model):
    score = {(r.doc_id, r.text): r.score for r in toxicity.score(docs, model).join(docs.select("doc_id", "text"), "doc_id", "left").collect()}
    left = toxicity.drop_toxic(docs, model)
    assert left.columns == docs.columns
    assert all(score.get((r.doc_id, r.text), 0) < toxicity.THRESHOLD or r.doc_id in (5, 8, 13, 16, 17) for r in left.collect())


def test_whole_run(spark, tmp_path, docs):
    folder = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, folder)
    assert out.count() > 0 and out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
