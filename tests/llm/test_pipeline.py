"""The corpus pipeline on a small folder of tables: every stage against a plain computation on its own input."""

import random
import re

import corpus_pipeline
import numpy as np
import pytest

from sirenflow.llm import simhash

r = random.Random(21)
VOCAB = ["".join(r.choices("bcdfghjk", k=r.randint(3, 8))) for _ in range(600)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n):
    return " ".join(r.choices(VOCAB, k=n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    item, passage, base = words(20), words(60) + ".", words(150)
    near = base.split()
    near[70] = "other"
    rows = [(k, words(80) + (" vile nasty" if k % 6 == 0 else ""), r.choice("ab")) for k in range(300)]
    rows += [(1000, base, "a"), (1001, base, "b"), (1002, " ".join(near), "c"), (1003, f"{words(30)}\n{passage}\n{words(30)}", "a"), (1004, f"{words(30)}\n{passage}\n{words(30)}", "b")]
    rows += [(1005, f"{words(50)} {item} {words(50)}", "a"), (1006, None, "b"), (1007, "", None), (None, words(40), None), (1000, base, "a")]
    spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 6 == 0)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), item, passage


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, folder):
    at, item, passage = folder
    docs = spark.read.parquet(f"{at}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    seen = [docs.collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, at)
        assert k == 4 or out.columns == docs.columns
        out.write.parquet(f"{at}/out{k}")
        docs = spark.read.parquet(f"{at}/out{k}")
        seen.append(docs.collect())
    ids = lambda rows: {x.doc_id for x in rows}
    assert not any(x.text and "vile" in x.text for x in seen[1]) and len(seen[1]) == len(seen[0]) - 50
    # one row of each group of copies and near copies stays, the lowest id
    groups = {}
    for x in seen[1]:
        own = shingles(x.text)
        head = next((g for g, s in groups.items() if (own and s and len(own & s) >= 0.8 * len(own | s)) or (not own and not s)), None)
        groups.setdefault(head if head is not None else (x.doc_id is None, x.doc_id), own) if head is None else None
    assert len(seen[2]) == len(groups) and 1000 in ids(seen[2]) and not {1001, 1002} & ids(seen[2])
    text = {x.doc_id: x.text for x in seen[3]}
    assert len(seen[3]) == len(seen[2]) and passage in text[1003] and passage not in text[1004]
    assert ids(seen[3]) - ids(seen[4]) == {1005}
    sizes = {x.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", x.text or "")) for x in seen[4]}
    assert {x.doc_id: x["size"] for x in seen[5]} == sizes and all(x.taken <= 3 * x["size"] for x in seen[5])
    assert abs(sum(x.taken for x in seen[5]) - sum(sizes.values())) <= 3


def test_run_gives_the_stages_rows(spark, folder):
    got = sorted(map(str, corpus_pipeline.run(spark, folder[0]).collect()))
    assert got == sorted(map(str, spark.read.parquet(f"{folder[0]}/out4").collect()))


def test_near_copies_are_searched_by_fingerprints(spark, monkeypatch):
    """Links are exact, and found among texts that a fingerprint leads to, in blocks of any size; texts of the same words in another order are none."""
    own, texts = random.Random(4), []
    vocab = ["".join(own.choices("bcdfghjk", k=own.randint(3, 9))) for _ in range(3000)]
    for n in (40, 150, 400):
        for _ in range(12):
            base = own.choices(vocab, k=n)
            texts.append(" ".join(base))
            for _ in range(3):
                near = base.copy()
                for at in own.sample(range(n), max(1, n // 80)):
                    near[at] = "x" + str(own.random())
                texts.append(" ".join(near))
            texts.append(" ".join(own.sample(base, n)))
    texts += ["", " ", "\n"]
    sets = [shingles(t) for t in texts]
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}

    def groups(links):
        root = list(range(len(texts)))
        for a, b in links:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        return root

    monkeypatch.setattr(simhash, "BLOCK_WORDS", 300)
    got = {(min(x.a, x.b), max(x.a, x.b)) for x in simhash.near_links(spark.createDataFrame(list(enumerate(texts)), "node long, text string")).collect()}
    root = groups(got)
    assert got <= want and sum(root[a] == root[b] for a, b in want) >= 0.9 * len(want) > 90
    # inside a class nothing is lost, whatever the order and the sides
    hashed = [simhash._shingle_set(t, 5) for t in texts]
    side = np.array([own.randrange(2) for _ in texts])
    assert groups(simhash._similar_forest(list(range(len(texts))), np.zeros(len(texts)), hashed, 0.8)) == groups(want)
    assert groups(simhash._similar_forest(list(range(len(texts))), side, hashed, 0.8)) == groups({(a, b) for a, b in want if side[a] != side[b]})


def test_a_crowd_of_alike_texts_makes_no_row_a_pair(spark, monkeypatch):
    own, base, rows, write = random.Random(6), [f"w{k}" for k in range(150)], [], simhash.saved
    texts = [" ".join(w if own.random() > 0.03 else "x" + str(own.random()) for w in base) for _ in range(150)]

    def spy(df):
        out = write(df)
        if df.columns == ["a", "b"]:  # pairs of texts
            rows.append(out.count())
        return out

    monkeypatch.setattr(simhash, "saved", spy)
    assert simhash.near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).count() > 1
    assert max(rows) < len(texts)
