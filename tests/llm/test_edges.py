"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import random

import numpy as np
import pytest

from brute import pii_base, pii_row
from cellscape.llm import decontaminate, embeddings, html_extract, licenses, mixing, ngram_join, pii, quality, toxicity, warc

DOCS = "doc_id long, text string, source string, pipes int, _text string, cluster string"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["w%d" % i for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(30_000))
    base = [rng.choice(words) for _ in range(60)]
    rows = [(1, None, "b", 1, "x", "c"), (2, "", None, None, None, None), (3, " \t\n ", "b", 1, "x", "c"), (4, long, "a", 1, "x", "c"),
            (5, long + " tail", "a", 1, "x", "c"), (6, "one two", "b", 1, "x", "c"), (6, "one two", "b", 1, "x", "c"), (7, "One  TWO", None, 1, "x", "c"),
            (8, " ".join(base), "a", 1, "x", "c"), (9, " ".join(base[:-1]), "c", 1, "x", "c"), (None, " ".join(base), "c", 1, "x", "c"),
            (10, "mail a.b@c.example.org now +1 (555) 123-4567, 4111 1111 1111 1111", "c", 1, "x", "c")]
    return spark.createDataFrame(rows, DOCS)


def brute_components(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if c < "\x80" else c for c in t or "").split()
        sets.append(frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    top = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same = rows[i][0] == rows[j][0]
            if same or a and b and den * len(a & b) >= num * len(a | b):
                low, high = sorted((top[i], top[j]))
                top = [low if x == high else x for x in top]
    least = {}
    for (d, _), t in zip(rows, top):
        least[t] = min(least.get(t, d), d)
    return sorted((d, len(s), least[t]) for (d, _), s, t in zip(rows, sets, top))


@pytest.mark.parametrize("n, num", [(4, 85), (5, 80)])
def test_jaccard_join_on_random_near_copies(spark, n, num):
    rng = random.Random(n)
    rows, words = [], ["t%d" % i for i in range(3000)]
    for size in (5, 8, 12, 20, 45, 120, 400, 900):
        base = [rng.choice(words) for _ in range(size)]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, 2 + size // 30)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy[rng.randrange(0, 1 + size // 25):])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(df, n, num, 100).collect())
    assert got == brute_components(rows, n, num, 100)


def test_jaccard_join_of_an_original_and_its_variants(spark):
    rng = random.Random(8)
    base = ["o%d" % i for i in range(60)]
    rows = [(0, " ".join(base))]
    for i in range(1, 1_201):   # each links with the original, few with each other
        at = rng.randrange(60)
        rows.append((i, " ".join(base[:at] + ["v%d" % i] + base[at + 1:])))
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted(tuple(r) for r in ngram_join.jaccard_components(df, 5, 80, 100).collect())
    assert got == brute_components(rows, 5, 80, 100)


def test_jaccard_join_edges(docs):
    rows = ngram_join.jaccard_components(docs, 4, 85, 100).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id))
    assert len(rows) == 12 and by[1] == by[1] and [by[i][0][0] for i in (1, 2, 3)] == [0, 0, 0]
    assert [by[i][0][1] for i in (1, 2, 3)] == [1, 2, 3]
    assert by[6] == [(1, 6), (1, 6)] and by[7] == [(1, 6)] and by[5][0][1] == 4 and by[9][0][1] == 8
    assert by[None][0][1] is None
    assert ngram_join.jaccard_components(docs.where("1 = 0")).count() == 0
    kept = [r.doc_id for r in ngram_join.one_of_each(docs).collect()]
    assert sorted(kept, key=repr) == sorted([1, 2, 3, 4, 6, 8, None, 10], key=repr)


def test_mix_edges(spark, docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == 12 and {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0}
    total = sum(r.size for r in rows)
    goal = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size and r.target <= 2 * r.source_size
        goal[r.source_size] = r.target
    assert abs(sum(r.taken for r in rows) - 1.5 * total) <= 4
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))
    spelled = mixing.copies(mixing.mix(docs)).groupBy("doc_id").sum("words").collect()
    taken = {}
    for r in rows:
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    assert {r[0]: r[1] for r in spelled} == {k: v for k, v in taken.items() if v}
    assert mixing.mix(docs.where("1 = 0")).count() == 0


def test_warc_round_trip(spark):
    pages = [(3, "http://a/\r\nX: y", "<p>same é</p>", 1), (1, None, "<p>same é</p>", 1), (2, "u", None, 1), (4, "u", "", 1),
             (None, "v", "<p>same é</p>", 1), (5, "w", "x" * 300_000, 1), (5, "w", "x" * 300_000, 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, sha int")
    index = warc.write_archives(df, warc.archive_folder(spark))
    assert index.count() == 7
    rows = warc.read_records(index).collect()
    kinds = sorted(((r.page_id, r.record_type, r.refers_to) for r in rows), key=repr)
    assert kinds == sorted([(3, "revisit", 1), (1, "response", None), (2, "response", None), (4, "revisit", 2), (None, "revisit", 1),
                            (5, "response", None), (5, "response", None)], key=repr)
    assert {r.html for r in rows if r.page_id == 5} == {"x" * 300_000} and len({r.payload_digest for r in rows}) == 3
    assert {r.payload_bytes for r in rows if r.page_id == 3} == {len("<p>same é</p>".encode())}
    some = warc.read_records(index.where("page_id = 1")).collect()
    assert [r.html for r in some] == ["<p>same é</p>"]
    assert warc.read_records(warc.write_archives(df.where("1 = 0"), warc.archive_folder(spark))).count() == 0
    small = warc.write_archives(df, warc.archive_folder(spark), least=1)
    assert small.where("page_id IN (2, 4) AND record_type = 'response'").count() == 2


def test_ranges_merge_neighbours():
    assert warc.ranges([(0, 10), (10, 10), (warc.GAP_BYTES + 21, 5)]) == [(0, 2, 0, 20), (2, 3, warc.GAP_BYTES + 21, warc.GAP_BYTES + 26)]


def test_pii_edges(spark, docs):
    texts = [None, "", "a@b.c_d@e.f x@y.z..q@r.s", "1.2.3.4.5.6.7.8.9 0255.1.1.1 256.1.1.1 00000000001.2.3.4", "4111 1111 1111 1111-- 4111-1111-1111-1111 5",
             "+1 (555) 123-4567) +12345678 +1 2 3 4 5 6 7 8 9 0 ", "1 2 3 4 " * 3000, "9" * 40_000, "a@b" + ".c" * 9000 + "..", "é@b.co ümail x.y@z.example.org.",
             "+4" + "-" * 9000 + "x", "." * 3000 + "@" + "a" * 3000 + ".b", "4242 4242 4242 4242 4"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, kind int")
    for r in pii.digest(pii.find(df, None)).collect():
        assert list(r)[1:6] == pii_row(texts[r.doc_id])
    model = pii.Model([(1.0, (2, 12.5, -3.0, 3.0))], {2: 0.9})    # digits > 12: a card
    extra = {r.doc_id: r.spans for r in pii.digest(pii.find(df, model)).collect()}
    assert "card:0:21" in extra[12] and extra[0] == ""
    clean = {r.doc_id: r for r in pii.redact(docs, None).collect()}
    assert clean[10].text == "mail [EMAIL] now [PHONE], [CARD]" and clean[1].text is None and clean[10]._text == "x"
    assert pii.fit(df.where("1 = 0")) is None and pii.fit(df.where("doc_id < 2")) is None
    assert pii.digest(pii.find(df.where("1 = 0"), None)).count() == 0
    assert pii_base("x")["email"] == []


def test_quality_and_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(4, 1, 0), (5, None, 1), (None, 0, 1), (8, 0, 5)], "doc_id long, quality int, toxic int")
    for label, module, low in (("quality", quality, 0.7), ("toxic", toxicity, 0.3)):
        rows = module.score(docs, module.fit(docs, labels.where("1 = 0"))).collect()   # nothing to learn from
        assert len(rows) == 12 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= low) for r in rows)
        rows = module.score(docs, module.fit(docs, labels, label)).collect()
        assert len(rows) == 12 and all(0 <= r.score <= 1 for r in rows)
        assert module.score(docs.where("1 = 0"), module.fit(docs, labels, label)).count() == 0
    everything = quality.accepted(docs, quality.RuleEnsemble([], 9.0))
    assert everything.columns == docs.columns and everything.count() == 12 and everything.where("pipes = 1").count() == 11


def test_rules_become_expressions(spark):
    df = spark.createDataFrame([(1, "a | b | c"), (2, "plain words here")], "doc_id long, text string")
    rule = ((quality.STATISTICS.index("pipes"), False, 0.1),)
    model = quality.RuleEnsemble([(-5.0, rule)], 2.0)
    got = {r.doc_id: round(r.score, 3) for r in quality.score(df, model).collect()}
    assert got == {1: round(1 / (1 + np.exp(3)), 3), 2: round(1 / (1 + np.exp(-2)), 3)}


def test_toxic_words_are_found(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(3, 8))) for _ in range(300)]
    rows = []
    for i in range(400):
        text = [rng.choice(words) for _ in range(60)]
        if i % 2:
            for _ in range(3):
                text[rng.randrange(60)] = rng.choice(["blockhead", "dumbwit", "vermin"])
        rows.append((i, " ".join(text), i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score(df.select("doc_id", "text"), toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)


def test_html_edges(spark):
    side = "<div class='sidebar'><p>" + "side " * 60 + "</p></div>"
    page = ("<html><head><title>T</title></head><body><header><h1>Site</h1></header><div id=\"cookie-notice\">We use cookies</div>" + side
            + "<div class=content><h2>T&eacute;st &lt;b&gt;</h2><p>" + "word " * 60 + "<p>a<br>b <i>c</i>d\n e</p><ul><li>one</li></ul></div>"
            + "<form><p>" + "input " * 50 + "</p></form><div class='comments'><p>" + "nice " * 50 + "</p></div><footer>(c) " + "foot " * 60)
    want = "Tést <b>\n" + " ".join(["word"] * 60) + "\na b cd e\none"
    rows = [(1, "u", None), (2, None, ""), (3, "u", page), (3, "u", page), (None, "u", "plain & simple"), (4, "u", "<nav>" + "menu " * 99), (5, "u", "< 3 <" * 20_000),
            (6, "u", "<article><p>short</p><div class=ad>buy</div><p>end</p></article><p>" + "other " * 90)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html_extract.extract(df.selectExpr("*", "1 AS text", "2 AS n_chars")).collect()
    texts = [r.text for r in got]
    assert texts[:5] == ["", "", want, want, "plain & simple"] and texts[5] == "" and texts[7] == "short\nend"
    assert texts[6] == " ".join(("< 3 <" * 20_000).split()) and all(r.n_chars == len(r.text) for r in got)
    assert html_extract.extract(df.where("1 = 0")).count() == 0


def test_names_that_only_mention_boilerplate():
    body = "<p>" + "word " * 60 + "</p>"
    text = " ".join(["word"] * 60)
    for around in ("<div class='content with-sidebar'>%s</div>", "<main class='no-sidebar'>%s</main>", "<article class='post has-comments'>%s</article>",
                   "<div id='page' class='has-header'>%s</div>", "<div data-id='search'>%s</div>", "<div class='content-sidebar-wrap'>%s</div>", "<div class='sidebar'>%s</div>",
                   "<div title='a class=\"ad\" here' id=reader>%s</div>", "<main id=search>%s</main>", "<div " + "data-x=y " * 500 + ">%s</div>", "<!" + "x" * 3_000 + ">%s"):
        assert html_extract.main_text("<body>" + around % body + "<div class=ad>buy</div></body>") == text, around[:60]
    for head in ("<h1 class='entry-header'>T</h1>", "<div class='article-header'><h1>T</h1></div>", "<div class='post-header'>T</div>"):
        assert html_extract.main_text("<article>" + head + body + "</article>") == "T\n" + text
    for name in ("site-footer", "mainNav", "cookie-banner", "related-posts", "post-comments", "share_buttons", "comments-area", "ad-slot-2", "sidebar"):
        assert html_extract.main_text("<div>" + body + "</div><div class='x " + name + "'><p>" + "side " * 50 + "</p></div>") == text, name
    assert html_extract.main_text("<div>" + body + "</div><div id=comments><p>" + "nice " * 500 + "</p></div>") == text
    assert html_extract.main_text("<div>" + body + "<p><a href=x>source</a></p></div>") == text + "\nsource"


def test_licence_edges(spark):
    assert len(licenses._known()) == len(licenses.SENTENCES)
    mit = licenses.SENTENCES[8] + ":\n\n" + licenses.SENTENCES[9] + "."
    bsd = ":\n".join(licenses.SENTENCES[i] for i in (22, 23, 24, 25)) + "."
    rows = [(1, None), (2, ""), (3, mit), (3, mit), (4, bsd), (5, licenses.SENTENCES[9] + ". " + licenses.SENTENCES[8] + "."), (None, "x. licensed under CC BY-NC 4.0. y"),
            (6, "word " * 50_000 + "\nReleased under the MIT License.\n" + "word " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.licences) for r in licenses.recognise(df.selectExpr("*", "1 AS ids")).collect()]
    assert got == [(1, ""), (2, ""), (3, "MIT"), (3, "MIT"), (4, "BSD-3-Clause"), (5, ""), (None, "CC-BY-NC-4.0"), (6, "MIT")]
    assert licenses.recognise(df.where("1 = 0")).count() == 0


def test_wrapped_licences(spark):
    import textwrap

    def wrapped(width, mark, *paragraphs):
        return "\n".join((mark + " " + line).rstrip() for p in paragraphs for line in textwrap.wrap(p, width) + [""])
    s = licenses.SENTENCES
    say = {"MIT": (s[8] + ":", s[9] + "."), "BSD-2-Clause": (s[22] + ":", "1. " + s[23] + ".", "2. " + s[24] + "."),
           "BSD-3-Clause": (s[22] + ":", "1. " + s[23] + ".", "2. " + s[24] + ".", "3. " + s[25] + "."), "ISC": (s[26] + ".",),
           "MPL-2.0": (s[27] + ". " + s[28] + " https://mozilla.org/MPL/2.0/.",), "GPL-3.0-or-later": (s[13] + ".", s[15] + ".  See the license."),
           "GPL-2.0-or-later": (s[14] + ". " + s[15] + ".",), "LGPL-2.1-or-later": (s[29] + ".",),
           "Apache-2.0": (s[2] + ";", s[3] + ". " + s[4], "http://www.apache.org/licenses/LICENSE-2.0")}
    rows, want = [], []
    for name, paragraphs in say.items():
        for width, mark in ((70, ""), (74, "#"), (66, " *"), (76, "//"), (60, "!"), (72, "dnl"), (5_000, "")):
            rows.append((len(rows), "Copyright (c) 2020 A B\n\n" + wrapped(width, mark, *paragraphs)))
            want.append(name)
    rows.append((len(rows), wrapped(70, "#", *say["BSD-2-Clause"]).replace("#\n", "").replace("\n", "\r\n")))   # no empty lines between
    want.append("BSD-2-Clause")
    rows.append((len(rows), "Some title\nReleased under the MIT License\nmore words"))
    want.append("MIT")
    rows.append((len(rows), s[22] + "\n\n" + s[23].replace("copyright notice, ", "copyright notice,\n\n") + "\n" + s[24]))   # across an empty line: no sentence
    want.append("")
    got = licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).orderBy("doc_id").collect()
    assert [r.licences for r in got] == want


def test_paraphrases_are_found(spark):
    rng = random.Random(5)
    words = ["k%d" % i for i in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(40)) + ". The answer is k%d k%d." % (i, i + 1)) for i in range(20)]
    rows = []
    for i, (_, text) in enumerate(items[:10]):
        w = text.split()
        for _ in range(5):
            w[rng.randrange(30)] = "other"
        around = [rng.choice(words) for _ in range(200)]
        rows.append((i, " ".join(around[:77] + w + around[77:])))
    rows += [(i, " ".join(rng.choice(words) for _ in range(300))) for i in range(10, 60)]
    rows += [(60, None), (61, ""), (None, items[3][1]), (62, items[4][1]), (62, items[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item_id")
    bench = spark.createDataFrame(items + [(98, None), (99, " ")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()), key=repr)
    assert got == sorted([(i, i) for i in range(10)] + [(None, 3), (62, 4), (62, 4)], key=repr)
    assert decontaminate.clean(df, bench).count() == len(rows) - 13
    assert decontaminate.contaminated(df, bench.where("1 = 0")).count() == 0
    assert decontaminate.contaminated(df.where("1 = 0"), bench).count() == 0


def test_long_and_short_items_are_found(spark):
    rng = random.Random(6)
    words = ["k%d" % i for i in range(3000)]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([400, 400, 700, 1000, 6, 6, 6, 8, 4, 12, 19, 30])]
    rows = []
    for i, text in items:
        for shift in (70, 73, 76, 79):
            around = [rng.choice(words) for _ in range(200)]
            rows.append((i * 10 + shift - 70, " ".join(around[:shift] + text.split() + around[shift:])))
    rows += [(i, " ".join(rng.choice(words) for _ in range(300))) for i in range(1000, 1060)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(df, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == sorted((i, i // 10) for i, _ in rows if i < 1000)


def test_subsequence_length():
    rng = random.Random(2)
    for _ in range(50):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(1, 30))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert decontaminate.Matcher(np.array(a)).common(b) == best[-1][-1]


def test_embeddings_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    rows, i = [], 0
    for label in (0, 1):
        base = rng.normal(size=(30, 16))
        for b in base:
            for _ in range(int(rng.integers(1, 8))):
                rows.append((i, label, [float(x) for x in b + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.12])]))
                i += 1
    odd = [(900, None, rows[0][2]), (901, 0, None), (902, 0, [0.0] * 16), (903, 0, [float("nan")] * 16), (904, 0, [None] + [1.0] * 15), (905, 0, []), (906, 0, [1.0, 2.0]),
           (907, 0, [2.0, 4.0]), (908, 0, rows[0][2]), (908, 0, rows[0][2]), (None, 0, rows[0][2])]
    df = spark.createDataFrame(rows + odd, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS space", "2 AS m")
    got = {}
    for r in embeddings.near_duplicates(df).collect():
        got.setdefault(r.vec_id, (r.n_links, r.component_id, r.kept))
    live = rows + odd[6:]
    ids = [r[0] for r in live]
    links = {k: set() for k in range(len(live))}
    for a in range(len(live)):
        for b in range(a):
            x, y = np.array(live[a][2]), np.array(live[b][2])
            if live[a][1] == live[b][1] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.98:
                links[a].add(b), links[b].add(a)
    for k, vec in enumerate(ids):
        seen, todo = {k}, [k]
        while todo:
            for o in links[todo.pop()] - seen:
                seen.add(o), todo.append(o)
        low = min(ids[s] for s in seen if ids[s] is not None)
        if vec is not None:
            assert got[vec] == (len(links[k]), low, vec == low), vec
        else:
            assert got[None][0] == len(links[k]) and got[None][1:] == (None, False)
    for vec in (900, 901, 902, 903, 904, 905):
        assert got[vec] == (0, vec, True)
    assert embeddings.near_duplicates(df.where("1 = 0")).count() == 0


def test_pipeline_stages(spark, pages_sf):
    import corpus_pipeline as pipeline
    from cellscape.session import stored

    docs = spark.read.parquet(f"{pages_sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{pages_sf}/labels.parquet").collect()}
    kept = {"start": {r.doc_id for r in docs.collect()}}
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, pages_sf), "stage")
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "mixing":
            assert docs.columns == columns
        if name == "near duplicates":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert kept[name] == {d for d, _, top in brute_components(rows, 5, 80, 100) if d == top}
        if name == "personal data":
            assert all(not any(pii_base(r.text).values()) for r in docs.collect()) and kept[name] == kept["decontamination"]
    gone = kept["start"] - kept["quality"]
    known = [labels[d] for d in gone if d in labels]
    assert gone and sum(known) <= 0.1 * len(known)
    assert len(kept["mixing"]) == len(kept["personal data"])
