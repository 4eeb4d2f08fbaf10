"""Further tests of the ten operators: independent brute force, wrapped texts, gradients, long and odd tables."""

import itertools
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from sirenflow.llm import chat_repair, common, decontaminate, html_extract, license_scan, quality_lines, simhash, substring_dedup, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
r = random.Random(11)
VOCAB = ["".join(r.choices("klmnopqrst", k=r.randint(3, 9))) for _ in range(500)]


def words(n):
    return " ".join(r.choices(VOCAB, k=n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


# ---- chat repair, with rules of its own


LEGAL = re.compile(r"s?(ua)*u?$")


def cheapest(roles):
    """Least cost over all legal outputs: a turn is merged into the one before, or becomes a turn of any role with up to two empty turns before it."""
    letters = {"system": "s", "user": "u", "assistant": "a"}
    best = {"": 0}
    for role in roles:
        new = {}
        for out, cost in best.items():
            own = letters.get(role)
            if out and (own is None or out[-1] == own):
                new[out] = min(new.get(out, 999), cost + 1 + (own is None))
            for n in range(3):
                for put in itertools.product("sua", repeat=n):
                    for x in "sua":
                        longer = out + "".join(put) + x
                        if LEGAL.match(longer):
                            price = cost + 2 * n + (0 if x == own else 1 if own is None else 3)
                            new[longer] = min(new.get(longer, 999), price)
        best = new
    return min(c + (2 if o == "s" else 0) for o, c in best.items())


def test_chat_repair_against_all_legal_outputs():
    letters = {"system": "s", "user": "u", "assistant": "a"}
    every = [c for n in range(1, 6) for c in itertools.product(("system", "user", "assistant", "unknown"), repeat=n)]
    for roles in r.sample(every, 250) + every[:84]:
        out, cost = "", 0
        for role, (action, new, put) in zip(roles, chat_repair.repair(list(roles)), strict=True):
            out += "".join(letters[p] for p in put)
            cost += 2 * len(put)
            if action == "merge":
                assert out[-1] == letters[new]
                cost += 1 + (role == "unknown")
            else:
                out += letters[new]
                cost += 0 if action == "keep" else 1 if role == "unknown" else 3
            assert action != "keep" or new == role
        if out == "s":
            out, cost = out + "u", cost + 2
        assert LEGAL.match(out) and len(out) > 0 and cost == cheapest(roles), roles


def test_chat_repair_splits_hot_conversations_and_equal_rows(spark):
    rows = [("hot", 1, r.choice(["user", "assistant"]), "x") for _ in range(300)] + [("hot", None, "user", None)] * 40 + [(f"c{k}", t, ["user", "assistant"][t % 2], f"{k} {t}") for k in range(50) for t in range(4)]
    t = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {n: sorted(map(str, chat_repair.repair_chats(t, block_turns=n).collect())) for n in (10, 100_000)}
    assert len(got[10]) == len(rows)
    hot = lambda g: (sum("'hot'" in x for x in g), sum("action='merge'" in x for x in g if "'hot'" in x))
    assert hot(got[10]) == hot(got[100_000]) and [x for x in got[10] if "'hot'" not in x] == [x for x in got[100_000] if "'hot'" not in x]
    one = chat_repair.repair_chats(spark.createDataFrame([(1, 0, "user", "w " * 200_000)], "conv_id long, turn long, role string, text string")).collect()
    assert len(one[0].rendered) > 400_000
    assert chat_repair.repair_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# ---- html


LONG = "This paragraph has enough words to be read as prose by anyone who looks at it."
PAGES = [
    ("<p>Hello there <script>x</script> world</p>", "Hello there world"),
    ("<p>Hello <button>b</button> you <select><option>1</select>too</p>", "Hello you too"),
    (f"<article><h1>T</h1><p>{LONG}</p><div class='related-work'><p>Prose here.</p></div><section id='responses'><p>More.</p></section></article>", f"T\n{LONG}\nProse here.\nMore."),
    (f"<article><p>{LONG}</p><div class=ad>buy</div><div class='ad-slot'>now</div><section class='comments'><p>{LONG}</p></section></article>", LONG),
    (f"<article><h2 id='comments'>Comments on the law</h2><p>{LONG}</p></article><article class='comment'><p>{LONG} Nice.</p></article>", f"Comments on the law\n{LONG}"),
    (f"<body><h1>Head</h1><div><p>{LONG}</p></div><div><p>{LONG} Again.</p></div></body>", f"Head\n{LONG}\n{LONG} Again."),
    (f"<body><div class=top><a href=a>A</a> <a href=b>B</a></div><div id=x><p>{LONG}</p><p>Short.</p></div><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></body>", f"{LONG}\nShort."),
    (f"<main><p>{LONG}</p><ul><li><a href=x>A source</a><li>Another</ul></main>", f"{LONG}\nA source\nAnother"),
    (f"<div role=main><header><h1>Title</h1></header><p>{LONG}</p></div><footer>f</footer>", f"Title\n{LONG}"),
    (f"<header><h1>Site</h1></header><article><header><h1>Own</h1></header><p>{LONG}</p></article>", f"Own\n{LONG}"),
    (f"<table><tr><td><p>{LONG}<td><p>{LONG} Two.</table>", f"{LONG}\n{LONG} Two."),
    (f"<nav>{LONG}</nav><aside>{LONG}</aside><form>{LONG}</form><noscript>{LONG}</noscript>", ""),
    (f"<p style='display:none'>{LONG}</p><p>{LONG}</p><p hidden>x</p>", LONG),
    (f"<p>{LONG}<br>&amp; more&nbsp;&eacute;&#x41;</p>", f"{LONG} & more éA"),
    (f"<article><p>{LONG} <a href=x>and a link</a></p></article>", f"{LONG} and a link"),
    (f"<div class='cookie-notice'><p>{LONG}</p></div><div class='legal-text'><p>{LONG} Law.</p></div>", f"{LONG} Law."),
    (f"<article><figure><img src=x><figcaption>A caption.</figcaption></figure><blockquote>{LONG}</blockquote></article>", f"A caption.\n{LONG}"),
    ("<p>one\n\t two</p><p></p><p> </p><pre>three\n four</pre>", "one two\nthree four"),
    (f"<article><p>{LONG}</div></p></b><p>x &lt; y", f"{LONG}\nx < y"),
    ("", ""), (None, ""), ("<<<>>", None), ("plain words only", "plain words only"),
]


@pytest.mark.parametrize("html,want", PAGES)
def test_pages(html, want):
    got = html_extract.main_text(html)
    assert want is None or got == want


def test_smoothing_against_a_plain_sum():
    for n in (1, 2, 7, 30):
        x = np.array([r.random() * 50 for _ in range(n)])
        for sigma in (0.5, 1.0, 2.5):
            reach = max(1, int(np.ceil(2 * sigma)))
            w = {k: np.exp(-(k**2) / (2 * sigma**2)) for k in range(-reach, reach + 1)}
            want = [sum(w[k] * x[min(n - 1, max(0, i + k))] for k in w) / sum(w.values()) for i in range(n)]
            assert np.allclose(html_extract.smooth(x, sigma), want)


def test_hostile_pages_take_linear_time():
    for page in ("<div>" * 40_000 + "deep", "<b>" * 30_000 + "<h1>x" * 30_000, "<b><p>" + "<i>" * 30_000 + "x</b>" * 30_000, "<p>" + "</div>" * 60_000):
        began = time.process_time()
        html_extract.main_text(page)
        assert time.process_time() - began < 12


# ---- licences


WRAPPED = {
    "MIT": "# Permission is hereby granted, free of charge, to any person obtaining a copy\n# of this software and associated documentation files (the \"Software\"), to deal\n# in the Software without restriction, including without limitation the rights\n# to use, copy, modify, merge, publish, distribute, sublicense, and/or sell\n# copies of the Software, and to permit persons to whom the Software is\n# furnished to do so, subject to the following conditions:",
    "GPL-3.0": "    This program is free software: you can redistribute it and/or modify\n    it under the terms of the GNU General Public License as published by\n    the Free Software Foundation, either version 3 of the License, or\n    (at your option) any later version.\n\n    This program is distributed in the hope that it will be useful,\n    but WITHOUT ANY WARRANTY; without even the implied warranty of\n    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\n    GNU General Public License for more details.\n\n    You should have received a copy of the GNU General Public License\n    along with this program.  If not, see <https://www.gnu.org/licenses/>.",
    "Apache-2.0": " * Licensed under the Apache License, Version 2.0 (the \"License\");\n * you may not use this file except in compliance with the License.\n * You may obtain a copy of the License at\n *\n *     http://www.apache.org/licenses/LICENSE-2.0\n *\n * Unless required by applicable law or agreed to in writing, software\n * distributed under the License is distributed on an \"AS IS\" BASIS,\n * WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.\n * See the License for the specific language governing permissions and\n * limitations under the License.",
}


def test_wrapped_headers_and_sentences_are_met(spark):
    rows = [(f"{k}/a", f"{words(40)}\nCopyright 2020 Some One\n{t}\n{words(60)}") for k, t in WRAPPED.items()]
    bsd = license_scan.TEMPLATES[[i for i, t in enumerate(license_scan.TEMPLATES) if t[0] == "BSD-3-Clause"][1]][1].split()
    rows.append(("BSD-3-Clause/LICENSE", "\n".join(" ".join(bsd[i : i + 11]) for i in range(0, len(bsd), 11))))
    rows += [("s/a", "Copyright 2020 Acme. Licensed under the Apache License, Version 2.0."), ("none/a", words(4000)), ("long/a", (words(50) + "\n") * 2000 + "Released under the MIT License.\n" + words(500))]
    rows += [(f"x/{k}", words(80)) for k in range(60)]
    got = {x.path: x for x in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for k in WRAPPED:
        if k != "MIT":  # its first paragraph alone is half a licence text
            assert got[f"{k}/a"].own_license == k and not got[f"{k}/a"].is_license_file
    assert got["BSD-3-Clause/LICENSE"].own_license == "BSD-3-Clause" and got["BSD-3-Clause/LICENSE"].is_license_file
    assert got["s/a"].own_license == "Apache-2.0" and got["none/a"].own_license is None and got["long/a"].own_license == "MIT"
    assert sum(got[f"x/{k}"].own_license is not None for k in range(60)) == 0


def test_windows_against_all_windows():
    for _ in range(50):
        terms, size = r.choices("abcdef", k=r.randint(0, 40)), r.randint(1, 12)
        template = frozenset("abc")
        got = list(license_scan.windows(terms, template, size, 0.6))
        n = min(size, len(terms))
        count = [sum(t in template for t in terms[i : i + n]) for i in range(len(terms) - n + 1)] if n else []
        want, run = [], []
        for i in [*range(len(count)), None]:
            if i is not None and count[i] >= 0.6 * size:
                run.append(i)
            elif run:
                best = max(run, key=lambda j: (count[j], -j))
                want.append((best, best + n))
                run = []
        assert got == want


# ---- toxicity


def test_gradient_against_differences():
    g = np.random.default_rng(3)
    size = 6
    rows = lambda n: toxicity.Rows([np.sort(g.choice(size, g.integers(0, 4), replace=False)) for _ in range(n)], [])
    p, u = rows(15), rows(40)
    for x in (p, u):
        x.val = g.random(len(x.col))
    for prior in (0.1, 0.6):
        for scale in (0.2, 6.0):
            w, b = g.normal(size=size) * scale, float(g.normal()) * scale
            pos, neg = toxicity.pu_risk(w, b, p, u, prior)
            f = (lambda w, b: sum(toxicity.pu_risk(w, b, p, u, prior))) if neg >= 0 else (lambda w, b: -toxicity.pu_risk(w, b, p, u, prior)[1])
            got, e = toxicity.pu_gradient(w, b, p, u, prior), 1e-6
            want = [(f(w + e * np.eye(size)[i], b) - f(w - e * np.eye(size)[i], b)) / (2 * e) for i in range(size)] + [(f(w, b + e) - f(w, b - e)) / (2 * e)]
            assert np.allclose(got, want, atol=1e-5)
    plain = [np.logaddexp(0, -(sum(x.val[x.row == i] * np.ones(size)[x.col[x.row == i]]) + 1)) for x in (p,) for i in range(p.n)]
    assert np.isclose(toxicity.pu_risk(np.ones(size), 1.0, p, u, 0.3)[0], 0.3 * np.mean(plain))


def test_toxicity_does_not_look_at_unlabelled_labels_and_takes_odd_tables(spark):
    rows = [(k, words(30) + (" venom" if k % 5 == 0 else ""), "a") for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(400)], "doc_id long, toxic int")
    long = rows + [(1000, "venom " * 100_000, "a"), (1001, words(100_000), "b")]
    got = {x.doc_id: x.predicted for x in toxicity.toxicity(docs(spark, long), labels).collect()}
    assert got[1000] == 1 and got[1001] == 0
    assert toxicity.toxicity(docs(spark, []), labels).count() == 0 and toxicity.drop_toxic(docs(spark, rows), labels).count() <= 325


# ---- the rest


def plain_units(text):
    """Lines, sentences of eight words in lines of eight, and runs around shorter ones, found by splitting anew."""
    at = 0
    for line in text.split("\n"):
        if line.split():
            yield at, at + len(line), " ".join(line.lower().split())
        if len(line.split()) >= 8:
            ends = [m.end() for m in re.finditer(r"[.!?]+(?=\s)", line)]
            cuts = sorted({0, *ends, len(line)})
            pieces = list(zip(cuts, cuts[1:], strict=False))
            n = [len(line[a:b].split()) for a, b in pieces]
            runs = set()
            for k in range(len(pieces)):
                if len(pieces) > 1 and n[k] >= 8:
                    runs.add((k, k))
                elif len(pieces) > 1 and n[k]:
                    for forward in (True, False):
                        total, j = n[k], k
                        while total < 8 and 0 <= j + (1 if forward else -1) < len(pieces):
                            j += 1 if forward else -1
                            total += n[j]
                        if total >= 8:
                            runs.add((min(j, k), max(j, k)))
            for a, b in runs - {(0, len(pieces) - 1)}:
                yield at + pieces[a][0], at + pieces[b][1], " ".join(line[pieces[a][0] : pieces[b][1]].lower().split())
        at += len(line) + 1


def test_units_against_another_splitting():
    for _ in range(200):
        text = "".join(r.choice(["word ", "Two words. ", "x! ", "\n", "end?  ", "more words in here. ", "é\tü "]) for _ in range(r.randint(0, 30)))
        mine = {(s, e, " ".join(text[s:e].lower().split())) for s, e, _ in substring_dedup.units(text)}
        assert mine == set(plain_units(text)), text


def test_key_filter_loses_nothing(spark):
    keys = [r.getrandbits(64) - (1 << 63) for _ in range(3000)]
    df = spark.createDataFrame([(k,) for k in keys[:1000]], "key long")
    f = common.KeyFilter(df, "key")
    hit = f.may_hold(np.array(keys, np.int64))
    assert hit[:1000].all() and hit[1000:].mean() < 0.15
    assert common.KeyFilter(df, "key", most_bits=16).may_hold(np.array(keys[:1000], np.int64)).all()
    assert not common.KeyFilter(df.limit(0), "key").may_hold(np.array(keys, np.int64)).any()


def test_text_ids_and_empty_tables(spark):
    line = words(30)
    t = spark.createDataFrame([("b", f"{line}\n{words(9)}"), ("a", f"{words(9)}\n{line}"), (None, line), ("c", None), ("d", "")], "doc_id string, text string").withColumn("source", F.lit("s"))
    got = {x.doc_id: x.removed_chars for x in substring_dedup.substring_dedup(t).collect()}
    assert got == {"a": 0, "b": len(line), None: len(line), "c": 0, "d": 0}
    assert simhash.near_dedup(t.union(t)).count() == 4
    none = t.limit(0)
    assert substring_dedup.substring_dedup(none).count() == simhash.fingerprint_components(none).count() == quality_lines.quality(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained(t, items).count() == 0 and decontaminate.decontaminate(none, items).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(pages).count() == 0


def test_quality_of_a_very_long_text(spark):
    got = quality_lines.quality(docs(spark, [(1, words(300_000), "a"), (2, (words(60) + "\n") * 3000, "a")])).collect()
    assert {x.n_words for x in got} == {300_000, 180_000}


def test_containment_is_bounded_by_bytes_and_exact(spark):
    item = words(40)
    rows = [(1, words(50) + " " + item + " " + words(50), "a"), (2, words(200), "a"), (3, " ".join(item.split()[:20]), "b")]
    items = spark.createDataFrame([(7, item), (None, item)], "item_id long, text string")
    for limit in (1 << 30, 0):
        got = sorted(map(str, ((x.id, x.item, x.n_found) for x in decontaminate.contained(docs(spark, rows), items, broadcast_bytes=limit).collect())))
        assert got == sorted(map(str, ((1, 7, 36), (1, None, 36))))


def test_warc_headers_and_split_size(spark, tmp_path):
    rows = [(k, f"u{k}", words(40) + ("WARC/1.1\r\nContent-Length: 4\r\n\r\nfake\r\n\r\n" if k % 3 == 0 else "")) for k in range(40)]
    t = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_warc(warc.plan_records(t), str(tmp_path / "w"))
    raw = "".join(p.read_bytes().decode() for p in (tmp_path / "w").glob("part-*"))
    assert raw.count("WARC-Date: 1970-01-01T00:00:00Z\r\n") == 40
    seen = []
    for size in ("900", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            seen.append(sorted((x.offset, x.record_id, x.intact) for x in warc.read_warc(spark, str(tmp_path / "w")).collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert seen[0] == seen[1] and len(seen[0]) == 40 and all(x[2] for x in seen[0])
    assert all(raw.encode()[o : o + 10] == b"WARC/1.1\r\n" for o, *_ in seen[0])


def test_licences_of_one_family_are_told_apart(spark):
    """Usual headers, wrapped as comments; none comes out as another version or family."""
    gnu = "This {w} is free software{c} you can redistribute it and/or modify it under the terms of the {n} as published by the Free Software Foundation{d} either version {v} of the License, or (at your option) any later version. This {w} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {n} for more details. "
    lib, out = "GNU Lesser General Public License", "You should have received a copy of the {n} along with this {w}. If not, see <http://www.gnu.org/licenses/>."
    cases = {
        "GPL-2.0": gnu.format(w="program", c=";", d=";", n="GNU General Public License", v="2") + out.format(w="program", n="GNU General Public License"),
        "GPL-3.0": gnu.format(w="program", c=":", d=",", n="GNU General Public License", v="3") + out.format(w="program", n="GNU General Public License"),
        "LGPL-2.1": gnu.format(w="library", c=";", d=";", n=lib, v="2.1") + "You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
        "LGPL-3.0": gnu.format(w="program", c=":", d=",", n=lib, v="3") + out.format(w="program", n=lib),
        "AGPL-3.0": gnu.format(w="program", c=":", d=",", n="GNU Affero General Public License", v="3") + out.format(w="program", n="GNU Affero General Public License"),
        "Apache-1.1": "Licensed under the Apache License, Version 1.1.",
        "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
        "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
        "Unlicense": "This is free and unencumbered software released into the public domain.",
        "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0",
        "CC-BY-4.0": "Licensed under CC BY 4.0",
        "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
    }
    rows = [(f"{k}/a", "\n".join([words(40), *(" * " + " ".join(x) for x in (t.split()[i : i + 11] for i in range(0, len(t.split()), 11))), words(60)]) if len(t.split()) > 40 else words(20) + "\n" + t + "\n" + words(20)) for k, t in cases.items()]
    rows += [(f"none{v}/a", f"{words(9)}\nLicensed under the Apache License, Version {v}.\n{words(9)}") for v in ("3.0", "1.0")]
    rows += [(f"x/{i}", words(50)) for i in range(40)]
    got = {r.path: r.own_license for r in license_scan.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {k: got[f"{k}/a"] for k in cases} == {k: k for k in cases}
    assert got["none3.0/a"] is None and got["none1.0/a"] is None


def test_substring_dedup_sends_texts_in_small_batches(spark, monkeypatch):
    """Whatever the session's batch size, no batch of texts to rewrite has more than BATCH_ROWS rows."""

    def bounded(texts, spans):
        from sirenflow.llm import substring_dedup

        if len(texts) > 20:
            raise ValueError(f"a batch of {len(texts)} texts")
        return substring_dedup.__dict__["_rewrite"](texts, spans)

    monkeypatch.setattr(substring_dedup, "BATCH_ROWS", 20)
    monkeypatch.setattr(substring_dedup, "_rewrite", bounded)
    line = words(30)
    t = docs(spark, [(k, f"{line}\n{words(9)}", "a") for k in range(100)]).coalesce(1)
    got = {x.doc_id: x.removed_chars for x in substring_dedup.substring_dedup(t).collect()}
    assert got == {k: len(line) if k else 0 for k in range(100)}
