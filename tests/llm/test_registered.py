"""The registered queries against their SQL or plain Python, on the smallest tables."""

import html
import re
import zlib

import pytest

from brute import pii_row
from cellscape.llm.queries import ORACLES, QUERIES
from check_queries import compare


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, tables, con, name):
    assert compare(QUERIES[name](spark, tables), con, ORACLES[name]) is None


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1


def test_main_texts(spark, pages_sf):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{pages_sf}/pages.parquet").collect()}
    rows = QUERIES["op1_html"](spark, pages_sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:h1|p)>", inside)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_base_spans(spark, tables):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{tables}/documents.parquet").collect()}
    rows = QUERIES["op8_pii"](spark, tables).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert list(r)[1:6] == pii_row(docs[r.doc_id])
        assert r.spans.count(":") >= 2 * sum(list(r)[1:5])


@pytest.mark.parametrize("name, label, least", [("op2_quality", "quality", 0.97), ("op4_toxicity", "toxic", 0.88)])
def test_held_out_accuracy(spark, pages_sf, name, label, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{pages_sf}/labels.parquet").collect()}
    rows = QUERIES[name](spark, pages_sf).collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    right = sum(r.predicted == labels[r.doc_id] for r in held)
    assert right >= least * len(held)


def test_contaminated_documents(spark, pages_sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{pages_sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{pages_sf}/benchmark.parquet").collect()]
    plain = lambda t: " " + " ".join(re.findall(r"[^\W_]+", t.lower())) + " "
    texts, items = [(i, plain(t)) for i, t in docs], [(i, plain(t)) for i, t in items]
    held = {(d, i) for d, t in texts for i, x in items if x in t}
    found = {(r.doc_id, r.item_id) for r in QUERIES["op3_decontamination"](spark, pages_sf).collect()}
    assert held and len(held - found) <= 0.02 * len(held) and not found - held
