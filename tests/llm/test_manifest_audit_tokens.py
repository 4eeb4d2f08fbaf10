"""Merkle manifest, conversation audit and token counts against plain computations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from sirenflow.llm import conversation_audit as ca
from sirenflow.llm import llm_queries, merkle, token_count

# ---------------------------------------------------------------- manifest


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def value(x) -> str:
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def levels(nodes: list[str]) -> list[list[str]]:
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
    return out


def steps(tree: list[list[str]], i: int) -> list[tuple[str, str]]:
    out = []
    for level in tree[:-1]:
        lo = i // 8 * 8
        out.append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 8])))
        i //= 8
    return out


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    """Rows (doc_id, text, lang, source, n_chars) to the query's rows, with lists and loops."""
    leaf = {k: sha("".join(map(value, (r[0], r[3], r[2], r[4], r[1])))) for k, r in enumerate(rows)}
    langs: dict = {}
    for k, r in enumerate(rows):
        langs.setdefault(r[2], []).append(k)
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for x in names:
        langs[x].sort(key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, leaf[k]))
        trees[x] = levels([leaf[k] for k in langs[x]])
    top = levels([trees[x][-1][0] for x in names])
    out = []
    for j, x in enumerate(names):
        for i, k in enumerate(langs[x]):
            path = steps(trees[x], i) + steps(top, j)
            r, h = rows[k], leaf[k]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                low = re.sub("[A-Z]", lambda m: m[0].lower(), r[1])
                h = sha("".join(map(value, (r[0], r[3], r[2], r[4], low))))
            for a, b in path:
                h = sha(a + h + b)
            out.append((r[0], leaf[k], trees[x][-1][0], top[-1][0], sha("".join(a + b for a, b in path)), h, h == top[-1][0]))
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))


@pytest.mark.parametrize("sizes", [[1], [8, 9, 1], [64, 65, 7, 1, 1, 1, 1, 1, 1, 1], [513, 4200]])
def test_manifest_is_that_of_lists(spark, tmp_path, sizes):
    rng = random.Random(sum(sizes))
    langs = [None, "", "de", "en", "é", "fr", "zz", "a", "b", "c"]
    rows = [(rng.choice([None, 1, 2, rng.randrange(10**6)]), rng.choice([None, "", "Ab É", "abc", "x" * 500]), langs[g], rng.choice([None, "S", "v:1"]), rng.choice([None, 3])) for g, n in enumerate(sizes) for _ in range(n)]
    rows += rows[:1]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in llm_queries.op11_merkle_manifest(spark, str(tmp_path)).collect()]
    assert ordered(got) == ordered(plain_manifest(rows))


def test_manifest_of_odd_tables(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    # names that the operator uses inside, and one lone row: its subroot and root are its leaf
    odd = spark.createDataFrame([(1, "t", "en", "s", 1, 7, 7, 7, 7)], SCHEMA + ", g int, h int, i int, n int")
    r = merkle.manifest(odd).first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["path"] == []
    # text ids, and groups that are numbers
    ids = spark.createDataFrame([("b", 2), ("a", 1), (None, None)], "k string, g long")
    m = merkle.manifest(ids, key="k", group="g", fields=("k", "g"), also={"size": F.length("k")})
    assert {r["k"]: r["size"] for r in m.collect()} == {"a": 1, "b": 1, None: None}
    assert m.where(merkle.fold(F.col("path"), F.col("leaf")) != F.col("root")).count() == 0


def test_manifest_joins_no_leaf_inside_a_block(spark):
    """Proofs inside a block come from explode: the only joins are by block."""
    plan = merkle.manifest(spark.createDataFrame([(k, "t", "en", "s", 1) for k in range(20)], SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") >= 2 * merkle.DIGITS and "Window" not in plan


# ---------------------------------------------------------------- conversations

LEGAL = re.compile("(s?(ua)+)?")
ROLES = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}


def exhaustive(symbols: str) -> tuple[int, str]:
    """Cheapest cost and ASCII-least audit over every edit string with at most two insertions in a row."""
    puts = [()] + [(a,) for a in "ua"] + list(itertools.product("ua", repeat=2))
    per_row = [[("D", "", 4)] + ([] if x == "-" else [("K", x.lower(), 3 * x.isupper()), *(("R", r, 3 + 3 * x.isupper()) for r in "ua")]) for x in symbols]
    best = (10**9, "")
    for edits in itertools.product(*per_row):
        for gaps in itertools.product(puts, repeat=len(symbols) + 1):
            cost = sum(e[2] for e in edits) + 3 * sum(map(len, gaps))
            if cost > best[0]:
                continue
            roles = "".join(gaps[0]) + "".join(e[1] + "".join(g) for e, g in zip(edits, gaps[1:], strict=True))
            if LEGAL.fullmatch(roles):
                audit = "I" * len(gaps[0]) + "".join(e[0] + "I" * len(g) for e, g in zip(edits, gaps[1:], strict=True))
                best = min(best, (cost, audit))
    return best


def one_chunk(symbols: str) -> tuple[int, str]:
    edits, cost, _ = ca.trace(symbols, ca.backward(symbols, ca.END), ca.START, True)
    return cost, "".join(e for e, _ in edits)


def test_audit_is_the_cheapest_and_least_of_all_edits():
    for n in range(3):
        for s in itertools.product(ca.SYMBOLS, repeat=n):
            assert one_chunk("".join(s)) == exhaustive("".join(s)), s
    rng = random.Random(3)
    for n, times in ((3, 40), (4, 2)):
        for _ in range(times):
            s = "".join(rng.choices(ca.SYMBOLS, k=n))
            assert one_chunk(s) == exhaustive(s), s


def plain_audit(rows: list[tuple]) -> dict:
    """Rows (conv, turn, role, text) after damage to the query's values by conversation, in one pass without chunks."""
    out: dict = {}
    by: dict = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    for conv, rs in by.items():
        rs.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        seen, symbols, counts = set(), "", {"b": 0, "d": 0, "t": 0}
        for _, _, role, text in rs:
            body = text.strip(" \t\n\v\f\r")
            fault = "b" if not body else "d" if (role, text) in seen else "t" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            x = role[:1] if role[:1] in ("s", "u", "a") else "x"
            symbols += "-" if fault in ("b", "d") and fault else x.upper() if fault else x
        cost, audit = one_chunk(symbols)
        k, state, parts = 0, 0, []
        for e in audit:
            if e in "RI":
                state = ca.PUT[state]
                parts.append(f"{ca.ROLE[state]}:{rs[k][3] if e == 'R' else ''}")
            elif e == "K":
                state = ca.KEPT[rs[k][2][:1], state]
                parts.append(f"{rs[k][2]}:{rs[k][3]}")
            k += e != "I"
        turns = {r[1] for r in rs} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:], strict=False))
        out[conv] = (gaps, counts["b"], counts["d"], counts["t"], illegal, cost, audit, sha("\n".join(parts)))
    return out


def plain_damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


NONE = (0, 0, 0, 0, 0, 0, "", sha(""))
TURNS = "conv_id long, turn long, role string, text string"


def as_dict(df) -> dict:
    got = df.collect()
    assert len({r[0] for r in got}) == len(got)
    return {r[0]: tuple(r)[1:] for r in got}


def test_audit_query_is_that_of_one_pass(spark, tmp_path):
    rng = random.Random(5)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", "Admin", "", None], ["Yes.", "No", "why?", "", " \n", "é!", "é! \t", None, "long " * 200 + "."]
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6, *range(10, 60)]), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(500)]
    rows += [(7, t, "user" if t % 2 == 0 else "assistant", f"turn {t}.") for t in range(300)] + rows[:20]
    spark.createDataFrame(rows, TURNS + "").withColumn("g", F.lit(1)).withColumn("row", F.lit(1)).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    got = as_dict(llm_queries.op12_conversation_audit(spark, str(tmp_path)))
    want = plain_audit(plain_damage(rows))
    assert got == {r[0]: want.get(r[0], NONE) for r in rows}


def test_chunks_of_hot_conversations_meet(spark):
    """Two conversations over many tasks, one of equal rows, one that no chunk can repair alone."""
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "tool"]), f"turn {t}" + rng.choice(["", ".", "."])) for t in range(3000)]
    rows += [(2, 1, "user", "same.")] * 400 + [(3, t, "user", f"{t}.") for t in range(5)] + [(4, None, "", "")] * 300
    df = spark.createDataFrame(rows, "conv long, turn long, role string, text string").repartition(5)
    got = as_dict(ca.audit(df, df.select("conv"), task_bytes=4_000))
    assert got == plain_audit(rows)


def test_fix_up_passes_find_the_vectors_of_one_pass(spark):
    rng = random.Random(1)
    for n in (2, 7):
        text = ["".join(rng.choices("uUaA-xs", weights=[5, 1, 5, 1, 1, 1, 0.1], k=rng.choice([1, 2, 30]))) for _ in range(n)] + ["-" * 40] * 3 + ["u" * 25]
        edges = spark.createDataFrame([(t, "a", s) for t, s in enumerate(text)] + [(0, "b", "ua")], "task int, g string, symbols string")
        known, passes = ca.stitched(edges)
        whole = ca.backward("".join(text), ca.END)
        at = 0
        for t, s in enumerate(text):
            at += len(s)
            assert known[t, "a"][0] == whole[at]
        assert (0, "b") not in known and passes <= len(text) + 1


def test_audit_of_empty_tables(spark):
    none = spark.createDataFrame([], "conv long, turn long, role string, text string")
    assert ca.audit(none, none.select("conv")).count() == 0
    some = spark.createDataFrame([(1,), (None,), (1,)], "conv long")
    assert as_dict(ca.audit(none, some)) == {1: NONE, None: NONE}


# ---------------------------------------------------------------- tokens


@pytest.fixture(scope="module")
def spec():
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def library(spec: str, texts: list[str | None]) -> list[int]:
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def odd_texts(n: int) -> list[str | None]:
    rng = random.Random(2)
    parts = [*"aAbBsStTrReEvVmMlLdDJjHhIi'.,;:!?|<>-_09 \t\n\x0b\x0c\r\x1c\x1f\x85\xa0 ̱̌̇éÉİßΣς　中文½²", "<|endoftext|>", "<|STARTOFTEXT|>", "<|startoftext|>", "'s", "'re", "The", " "]
    return ["".join(rng.choices(parts, k=rng.randint(0, 50))) for _ in range(n)] + [None, "", " \n", "a" * 20_000, "Word. " * 5_000, "é" * 3_000]


def test_words_depend_on_no_other_text():
    import pyarrow as pa

    texts = [(x or "").encode() for x in odd_texts(1_500)]
    alone = [list(token_count.words_of(pa.array([x], pa.binary())))[0] for x in texts]
    assert list(token_count.words_of(pa.array(texts, pa.binary()))) == alone
    assert list(token_count.words_of(pa.array(texts, pa.binary())[700:])) == alone[700:]


@pytest.mark.parametrize("head_bytes", [0, 1_500, token_count.HEAD_BYTES])
def test_counts_are_those_of_the_library(spark, spec, head_bytes):
    texts = odd_texts(1_500)
    rows = [(k if k % 7 else None, x, 1, 1) for k, x in enumerate(texts)] + [(3, "Same text.", 1, 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, row int, word int").repartition(3)
    got = token_count.token_counts(df, spec, limit=100, head_bytes=head_bytes).collect()
    want = library(spec, [r[1] for r in rows])
    plain = [(r[0], len((r[1] or "").encode()), n, n > 100) for r, n in zip(rows, want, strict=True)]
    assert ordered(map(tuple, got)) == ordered(plain)


def test_counts_of_empty_tables_and_text_keys(spark, spec):
    none = spark.createDataFrame([], "doc_id string, text string")
    assert token_count.token_counts(none, spec).collect() == []
    one = spark.createDataFrame([("k", None)], "doc_id string, text string")
    assert [tuple(r) for r in token_count.token_counts(one, spec).collect()] == [("k", 0, 0, False)]


def test_a_tokenizer_that_keeps_white_space_is_refused(spark):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f, pytest.raises(ValueError):
        token_count.token_counts(spark.createDataFrame([("k", "t")], "doc_id string, text string"), f.read())
