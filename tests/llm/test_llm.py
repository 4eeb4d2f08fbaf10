"""The ten operators against brute force on small tables with nulls, ties, repeats, long and empty texts, clashing columns."""

import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sirenflow.llm import chat_repair, decontaminate, html_extract, license_scan, mixing, quality_lines, simhash, substring_dedup, toxicity, warc
from sirenflow.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(5)
VOCAB = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(400)]


def words(n, r=rng):
    return " ".join(r.choices(VOCAB, k=n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def mixed():
    base = words(200)
    near = base.split()
    near[50] = "changed"
    line = words(60)
    rows = [(1, base, "a"), (2, base, "a"), (3, " ".join(near), "b"), (4, None, None), (5, "", "b"), (6, " \n\t", "b"), (7, words(5000), "a"), (None, words(80), "c"), (8, words(20) + "\n" + line + "\n" + words(30), "a"), (9, words(25) + "\n" + line.upper() + "\n" + words(20), "c"), (9, "other " + words(40), "c"), (10, "one", "b")]
    rows += [(10 + k, words(60), rng.choice("abc")) for k in range(1, 20)]
    return rows + [rows[0], rows[-1]]


def brute_fp(t, k=3):
    w = (t or "").encode().lower().split()
    sh = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_simhash_matches_brute_force(spark, mixed):
    got = simhash.fingerprint_components(docs(spark, mixed).withColumn("fp", F.lit(1))).collect()
    want = [(i, brute_fp(t)) for i, t, _ in mixed]
    group = list(range(len(want)))
    for a, b in combinations(range(len(want)), 2):
        if (want[a][1] ^ want[b][1]).bit_count() <= 3:
            x, y = group[a], group[b]
            group = [x if g == y else g for g in group]
    low = {g: min((want[k][0] for k in range(len(want)) if group[k] == g and want[k][0] is not None), default=None) for g in set(group)}
    assert sorted(map(str, ((r.doc_id, r.fingerprint, r.component_id) for r in got))) == sorted(str((i, f"{f:016x}", low[g])) for (i, f), g in zip(want, group, strict=True))


def test_dense_cells_give_the_same_components(spark):
    r = np.random.default_rng(1)
    centre = [int(x) for x in r.integers(0, 1 << 63, 3)]
    fps = sorted({c ^ sum(1 << int(b) for b in r.choice(62, r.integers(0, 6), replace=False)) for c in centre for _ in range(60)})
    table = spark.createDataFrame([(0, f) for f in fps], "s int, fp long")
    root = {f: f for f in fps}
    for a, b in combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            x, y = root[a], root[b]
            root = {k: (min(x, y) if v in (x, y) else v) for k, v in root.items()}
    want = {f: v for f, v in root.items() if list(root.values()).count(v) > 1}
    for limit in (2, 10_000):
        got = {x.node: x.root for x in components(simhash.fingerprint_links(table, cell_limit=limit)).collect()}
        sets = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
        assert sets(got) == sets(want)


def test_components_of_a_long_path(spark):
    ids = list(range(60))
    rng.shuffle(ids)
    links = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)) + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert {got[i] for i in range(60)} == {0} and got[101] == got[100] == 100


def test_near_dedup_keeps_one_of_each_group(spark, mixed):
    got = simhash.near_dedup(docs(spark, mixed).withColumn("node", F.lit("x")))
    assert got.columns == DOCS.replace(" long", "").replace(" string", "").split(", ") + ["node"]
    ids = [r.doc_id for r in got.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and {7, 8, 9}.issubset(ids) and ids.count(None) == 1
    assert sum(i in ids for i in (4, 5, 6)) == 1 and len(ids) == len(mixed) - 2 - 2 - 2
    assert simhash.near_dedup(docs(spark, [])).count() == 0


def test_substring_dedup_matches_brute_force(spark, mixed):
    got = substring_dedup.substring_dedup(docs(spark, mixed).withColumn("spans", F.lit(0)))
    rows = {(r.doc_id, r.n_chars): r for r in got.collect()}
    first, cuts = {}, {}
    uniq = {(i, t) for i, t, _ in mixed if t}
    import hashlib

    for i, t in sorted(uniq, key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5(x[1].encode()).digest())):
        for s, e, u in sorted(substring_dedup.units(t)):
            if first.setdefault(u, (i, t, s)) != (i, t, s):
                cuts.setdefault((i, len(t)), []).append((s, e))
    for i, t, _ in mixed:
        r = rows[(i, None if t is None else len(t))]
        want = substring_dedup.cover(cuts.get((i, len(t or "")), []))
        assert [(x.start, x.stop) for x in r.removed] == want and r.removed_chars == sum(e - s for s, e in want)
        assert r.text == (substring_dedup.without(t, want) if want else t)
    assert got.count() == len(mixed) and rows[(9, len(mixed[9][1]))].removed_chars > 0 and rows[(1, len(mixed[0][1]))].removed == []


def test_mix_meets_targets(spark, mixed):
    got = mixing.mix(docs(spark, mixed), rows_per_range=4).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(map(str, ((r.doc_id, r["size"]) for r in got))) == sorted(str((i, size(t))) for i, t, _ in mixed)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert 0 <= r.taken <= 3 * r["size"]
    names = sorted(by, key=lambda s: (s is None, s))
    total, weight = sum(size(t) for _, t, _ in mixed), {s: k % 3 + 1 for k, s in enumerate(names)}
    cap, full = {s: 3 * sum(r["size"] for r in by[s]) for s in names}, set()
    while True:
        rest, w = total - sum(cap[s] for s in full), sum(weight[s] for s in names if s not in full)
        target = {s: cap[s] if s in full else rest * weight[s] / w for s in names}
        over = {s for s in names if s not in full and target[s] >= cap[s]}
        if not over:
            break
        full |= over
        if len(full) == len(names):
            target = cap
            break
    for s in names:
        assert by[s][0].target == pytest.approx(target[s]) and sum(r.taken for r in by[s]) == int(target[s])
    assert mixing.mix(docs(spark, [])).count() == 0


def test_toxicity_learns_only_from_training_folds(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        bad = r.random() < 0.15
        rows.append((i, words(60, r) + (" vile, nasty VILE" if bad else "") + " " + words(20, r), "a"))
        fold = zlib.crc32(str(i).encode()) % 3
        labels.append((i, 1, int(bad) if fold != 1 else 1 - int(bad)))
    rows += [(900, None, "a"), (901, "", "a"), (None, "x", "a")]
    got = toxicity.toxicity(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    held = [(x.predicted, "vile" in rows[x.doc_id][1]) for x in got if x.held_out and x.doc_id < 900]
    assert sum(p == t for p, t in held) / len(held) > 0.98
    assert all(0 <= x.score <= 1 for x in got) and not [x for x in got if x.doc_id is None][0].held_out
    empty = toxicity.toxicity(docs(spark, rows[:5]), spark.createDataFrame([], "doc_id long, quality int, toxic int")).collect()
    assert len(empty) == 5 and {x.predicted for x in empty} == {0}


def test_quality_base_counts():
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        rep = {i + k for i, x in enumerate(win) if win.count(x) > 1 for k in range(3)}
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(rep)

    for t in ("", "a b", "a b c a b c", "é x # <b>\nq\nq\n\n q", " ".join(rng.choices("abcd", k=200)), "\x1c \x85  \n"):
        assert quality_lines.base_counts(t) == brute(t)
    assert quality_lines.base_counts(None) == (0,) * 5


def test_quality_rejects_depleted_documents(spark):
    foot = "home about contact terms privacy cookies login " * 10
    rows = [(i, words(70) + "\n" + foot, "h") for i in range(30)] + [(100 + i, f"{words(60)}\n{foot}\n{foot}", "h") for i in range(3)] + [(200, words(100), "h"), (None, None, None), (0, None, "h")]
    got = {(r.doc_id, r.n_words): r for r in quality_lines.quality(docs(spark, rows + rows[:1])).collect()}
    assert not got[(100, 200)].kept and got[(100, 200)].n_left == 60 and got[(200, 100)].kept and got[(None, 0)].base_failed
    assert got[(0, 140)].n_left == 70 and got[(0, 140)].kept
    assert quality_lines.quality(docs(spark, [])).count() == 0


@pytest.mark.parametrize("limit", [500_000, 0])
def test_containment_matches_brute_force(spark, mixed, limit):
    item = words(20)
    part = " ".join(item.split()[:18]) + " zz"
    rows = mixed + [(50, words(500) + "\n" + item.upper().replace(" ", ", ") + "\n" + words(500), "a"), (51, words(30) + " " + part, "a"), (52, " ".join(item.split()[:10]), "a")]
    items = [(1, item), (2, "one"), (3, None), (4, "!!"), (5, words(15))]
    got = {(r.id, r.item): r.n_found for r in decontaminate.contained(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=limit).collect()}

    def shingles(t, k):
        w = re.findall(r"[a-z0-9]+", (t or "").lower())
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    want = {}
    for n, t in items:
        k = min(5, len(re.findall(r"[a-z0-9]+", (t or "").lower())))
        own = shingles(t, k) if k else set()
        for i, x, _ in rows:
            m = len(own & shingles(x, k)) if own else 0
            if own and m >= 0.8 * len(own) - 1e-9:
                want[(i, n)] = m
    assert got == want and (50, 1) in got and (51, 1) in got and (10, 2) in got
    kept = decontaminate.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert kept.columns == docs(spark, []).columns and kept.count() == len(rows) - len([r for r in rows if any(k[0] == r[0] for k in want)])


def test_html_main_text(spark):
    page = """<html><head><title>t</title><script>var x='<p>no</p>';</script></head><body><div class="cookie-notice"><p>We use cookies a lot on this site, and more.</p></div><nav><a href=x>Home</a></nav>
<div id="content"><h2>Title &eacute;</h2><p>Some <a href=1>link</a> text that is\n long enough&nbsp;here.<p>Short.<ul><li>one<li>two</ul><!-- no --><div class="comments"><p>I am a reader comment that is quite long, longer than others.</div></div>
<aside>side</aside><form><input><label>Name</label></form><footer>foot</footer></body>"""
    assert html_extract.main_text(page) == "Title é\nSome link text that is long enough here.\nShort.\none\ntwo"
    assert html_extract.main_text(None) == html_extract.main_text("") == html_extract.main_text("<p>") == ""
    rows = [(1, "u", page), (1, None, None), (None, "v", "<article><p>x &lt; y</article>"), (2, "w", "<div>" * 3000 + "deep")]
    got = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)))
    assert sorted((r.text, r.n_chars) for r in got.collect())[0] == ("", 0) and {"x < y", "deep"} <= {r.text for r in got.collect()}


def test_warc_chain_rejects_magic_in_payloads(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(1, "u\r\nx", "a" + fake), (2, None, fake), (3, "w", "WARC/1.1\r\nWARC/1.1\r\n"), (4, "w", ""), (None, "n", None), (5, "é", "é" * 5000), (6, "z", "é" * 5000), (6, "z", "é" * 5000), (7, "q", "x\r\n\r\n")]
    rows += [(100 + i, "u", words(30)) for i in range(50)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = warc.warc_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("id", F.lit(0)).coalesce(2), str(tmp_path / "w")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    import base64
    import hashlib

    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = [(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", None) if i == top[h or ""] else ("revisit", top[h or ""]))) for i, _, h in rows]
    assert sorted(map(str, ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))
    assert all(r.intact for r in got if r.record_type == "response")
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def best_cost(roles):
    cost = {chat_repair.START: 0}
    for r in roles:
        new = {}
        for s, t, c, *_ in chat_repair.steps(r):
            if s in cost:
                new[t] = min(new.get(t, 10**9), cost[s] + c)
        cost = new
    return min(c + chat_repair.closing(s) for s, c in cost.items())


def test_chat_repair_is_legal_and_cheapest(spark):
    for _ in range(200):
        roles = rng.choices(["system", "user", "assistant", "unknown"], k=rng.randint(1, 7))
        state, cost = chat_repair.START, 0
        for r, (action, role, put) in zip(roles, chat_repair.repair(roles), strict=True):
            for p in put:
                state, cost = chat_repair.LEGAL[state][p], cost + 2
            if action == "merge":
                assert chat_repair.HOLDS[state] == role
                cost += 1 + (r == "unknown")
            else:
                state, cost = chat_repair.LEGAL[state][role], cost + (0 if action == "keep" else 3 if r != "unknown" else 1)
        assert cost + chat_repair.closing(state) == best_cost(roles)
    rows = [(1, t, rng.choice(["system", "user", "assistant", "Bot", None]), None if t == 3 else f"t{t}") for t in range(40)] + [(None, None, "user", "x"), (2, 0, "assistant", "a"), (2, None, "user", "n"), (2, 0, "assistant", "a")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("block", F.lit(1))
    key = lambda x: str(tuple(x))
    whole, blocks = sorted(map(key, chat_repair.repair_chats(t).collect())), chat_repair.repair_chats(t, block_turns=7)
    mine = blocks.where("conv_id = 1").orderBy("turn").collect()
    roles = ["unknown" if r in ("Bot", None) else r for c, _, r, _ in rows if c == 1]
    cost = sum(2 * len(r.inserted) + (1 + (roles[k] == "unknown") if r.action == "merge" else 0 if r.action == "keep" else 3 if roles[k] != "unknown" else 1) for k, r in enumerate(mine))
    assert cost == best_cost(roles) and len(whole) == len(rows) == blocks.count()


def test_license_scan_and_inheritance(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x", words(30)), ("a/b/c/y", words(9) + "\nLicensed under the Apache License, Version 2.0.\n" + words(9)), ("z/q", words(10)), ("a/b/c/n", None), (None, "All rights reserved."), ("a/b/x", words(5))]
    got = {(r.path, r.own_license): r for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string").withColumn("dir", F.lit(1))).collect()}
    assert got[("a/LICENSE", "MIT")].is_license_file and got[("a/b/x", None)].license == "MIT" and got[("a/b/x", None)].inherited_from == "a/LICENSE"
    assert got[("a/b/c/y", "Apache-2.0")].license == "Apache-2.0" and got[("z/q", None)].license is None and got[("a/b/c/n", None)].license == "MIT"
    assert got[(None, "proprietary")].inherited_from is None
    assert license_scan.scan(spark.createDataFrame([], "path string, text string")).count() == 0


def test_license_scores_against_brute_force(spark):
    notices = (("A", "alpha beta gamma"), ("A", "alpha beta beta delta"), ("B", "alpha 2.0 beta"))
    rows = [(str(k), "\n".join(" ".join(rng.choices(["Alpha", "beta", "gamma,", "delta", "(2.0)", "other"], k=rng.randint(0, 5))) for _ in range(3))) for k in range(40)]
    term = lambda t: [w for w in (x.strip(".+-") for x in re.split("[^a-z0-9.+-]+", t.lower())) if w]
    df = {t: sum(t in term(x) for _, x in rows) for _, n in notices for t in term(n)}
    idf = lambda t: np.log((len(rows) + 1) / (df.get(t, 1) + 1)) + 1
    vec = lambda w: {t: w.count(t) * idf(t) for t in set(w)}
    cos = lambda a, b: sum(x * b.get(t, 0) for t, x in a.items()) / np.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    got = {r.path: r for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string"), templates=notices).collect()}
    for p, text in rows:
        lines = [vec(term(x)) for x in text.split("\n") if len(set(term(x)) & set(df)) >= 2]
        best = max((cos(v, vec(term(n))) for v in lines for _, n in notices), default=0)
        if abs(best - 0.8) > 1e-9:
            assert (got[p].score is not None) == (best > 0.8) and (best < 0.8 or abs(got[p].score - best) < 1e-5)


def test_similar_links_find_every_pair(spark):
    r = random.Random(8)
    texts = []
    for n in (12, 40, 150, 400):
        for edits in (1, 2, 3, 4, 8):
            base = words(n, r).split()
            texts.append(" ".join(base))
            for _ in range(3):
                other = base.copy()
                for _ in range(max(1, n * edits // 200)):
                    other[r.randrange(n)] = "x" + str(r.random())
                texts.append(" ".join(other))
    texts = sorted({*texts, "", "  ", "a b c", "a  b c"})
    sets = [set(zip(*(t.lower().split()[i:] for i in range(5)), strict=False)) if len(t.split()) > 4 else {tuple(t.split())} - {()} for t in texts]
    want = {(i, j) for i, j in combinations(range(len(texts)), 2) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    table = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    got = {(x.a, x.b) for x in simhash.similar_links(table).collect()}
    assert got == want and len(want) > 30


def test_dense_postings_test_every_open_pair(spark):
    r = random.Random(9)
    base = words(100, r).split()
    texts = []
    for k in range(40):  # half of the words in another order: equal word sets
        far = base.copy()
        tail = far[50:]
        r.shuffle(tail)
        texts.append(" ".join(far[:50] + tail))
        texts.append(" ".join(far[:50] + tail[:-1] + [f"end{k}"]))
    table = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    want = {(2 * k, 2 * k + 1) for k in range(40)}
    assert {(x.a, x.b) for x in simhash.similar_links(table, posting_limit=1).collect()} == want


def test_substring_dedup_cuts_short_lines_and_short_sentences_of_repeated_runs(spark):
    passage = words(12) + ". Of, edti. " + words(12) + ". So it. Was so. " + words(12) + "."
    rows = [(1, f"Short line.\n{words(20)}. {passage} {words(20)}.", "a"), (2, f"{words(20)}. So it. {words(20)}.\nshort  LINE.", "a"), (3, f"{words(20)}. {passage} {words(20)}.", "a")]
    got = {r.doc_id: r.text for r in substring_dedup.substring_dedup(docs(spark, rows)).collect()}
    assert got[1] == rows[0][1] and got[2] == rows[1][1].split("\n")[0] + "\n"
    first, last = rows[2][1].split(". ")[0], rows[2][1].split(". ")[-1]
    assert got[3] == f"{first}. {last}"


def test_chat_of_system_turns_only_gets_its_user_turn(spark):
    rows = [(1, 0, "system", "a"), (1, 1, "system", "b"), (2, 0, "system", "a"), (2, 1, "user", "q"), *[(3, t, "system", "s") for t in range(20)]]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for block in (4096, 7):
        got = sorted(chat_repair.repair_chats(t, block_turns=block).collect(), key=lambda r: (r.conv_id, r.turn))
        text = {c: "".join(r.rendered for r in got if r.conv_id == c) for c in (1, 2, 3)}
        assert text[1] == "<|system|>\na\nb\n<|user|>\n\n" and text[2] == "<|system|>\na\n<|user|>\nq\n" and text[3].count("<|user|>") == 1
        assert text[3].endswith("s\n<|user|>\n\n") and [r.inserted_after for r in got if r.conv_id == 1] == [[], ["user"]]


def test_html_keeps_all_containers_of_a_page_without_article():
    row = [f"Row {k} of the text has a good many words, enough to be read as prose." for k in range(3)]
    for page in ("<div id=content>{}</div>", "<table><tr>{}</tr></table>"):
        tag = "td" if "table" in page else "div"
        body = page.format("".join(f"<{tag}><p>{x}</p></{tag}>" for x in row))
        assert html_extract.main_text(f"<body><nav><a href=x>Home</a></nav>{body}<footer>foot</footer></body>") == "\n".join(row)
