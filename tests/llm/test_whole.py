"""Cases in which an operator or a stage once did less than its whole job."""

from __future__ import annotations

import brute
import corpus_pipeline
from cases import DOCS, sentence
from pyspark.sql import functions as F

from tracemill.llm import block_dedup, html_tree, langid, minhash, suffix_dedup


def near(docs: list[tuple], size: int) -> dict[int, tuple[int, int, bool]]:
    """brute.near for shingles of any size, by comparing all pairs."""
    sets = {}
    for i, t in ((r[0], r[1]) for r in docs):
        w = brute.WORD.findall((t or "").encode().lower())
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]))
                root = {k: a if v == b else v for k, v in root.items()}
    return {i: (len(s), root[i], root[i] == i) for i, s in sets.items()}


def edited(rng, words: list[str], at: int) -> str:
    return " ".join([*words[:at], "zz", *words[at + 1 :]])


def test_shingles_of_five_words(spark):
    """One edit in 40 words leaves 33 of 41 shingles of four words, but 31 of 41 of five."""
    import random

    rng, rows = random.Random(8), []
    for k, n in enumerate([40, 40, 90, 48, 50, 44, 5, 4, 3]):
        words = sentence(rng, n).split(" ")
        rows += [(2 * k, " ".join(words), "en", "a", 1), (2 * k + 1, edited(rng, words, n // 2), "en", "a", 1)]
    rows += [(50, None, "en", "a", 0), (51, rows[0][1], "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    for size in (4, 5):
        found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs, shingle=size).collect()}
        assert found == near(rows, size)
    assert near(rows, 4) == brute.near([r[:2] for r in rows]) and near(rows, 4)[1][2] != near(rows, 5)[1][2]
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {i for i, x in near(rows, 5).items() if x[2]}


def test_suffix_dedup_of_ids_that_repeat(spark):
    """A null id of 5000 bytes repeats itself beyond the end of another null id's text; twins keep their first copy."""
    import random

    rng = random.Random(12)
    long, short, other, twin = (sentence(rng, 2000)[:n] for n in (4000, 200, 300, 400))
    rows = [(None, long + long[:1000]), (None, short), (7, other), (7, other[100:250] + short[:150]), (8, twin), (8, twin)]
    found = suffix_dedup.remove_repeated_spans(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault((r.doc_id, r.n_bytes), []).append(r)
    assert by[None, 5000][0].kept_text == long and by[None, 5000][0].n_spans == 1
    assert by[None, 200][0].kept_text == short
    pair = by[7, 300]
    assert len(pair) == 2 and sorted(r.n_removed for r in pair) in ([0, 300], [150, 150])  # the passage that both hold stays once
    assert [r.kept_text for r in by[8, 400]] == [twin, twin]


def test_block_dedup_of_ids_that_repeat(spark):
    """Places of one row never count for another row of its id: the short ones have no word there."""
    import random

    rng = random.Random(13)
    base, long = sentence(rng, 60), sentence(rng, 400)
    rows = [(1, base), (5, f"{long} {base}"), (5, "a b c"), (None, f"{long} x {base}"), (None, "d e"), (9, base), (9, base)]
    found = block_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect()
    got = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in found)
    assert got == [(-1, 2, 0), (-1, 461, 0), (1, 60, 60), (5, 3, 0), (5, 460, 460), (9, 60, 60), (9, 60, 60)]


def test_pipeline_keeps_rows_by_id_and_text(spark):
    """Null ids and a repeated id with other texts all pass; a copy of a null id's text goes, the text does not."""
    import random

    rng = random.Random(14)
    a, b, c, d = (sentence(rng, 40) for _ in range(4))
    rows = [(None, a, "en", "s", 1), (None, b, "en", "s", 1), (3, c, "en", "s", 1), (3, d, "de", "s", 1), (3, d, "en", "s", 1), (4, a, "en", "s", 1), (5, b.upper(), "en", "s", 1), (None, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    left = corpus_pipeline.near_dedup(spark, docs, "")
    tuples = lambda df: sorted(map(tuple, df.select("doc_id", "text", "lang").collect()), key=str)
    want = sorted([(None, a, "en"), (None, b, "en"), (3, c, "en"), (3, d, "de"), (None, None, "en")], key=str)
    assert tuples(left) == want
    cut = corpus_pipeline.span_dedup(spark, left, "")
    assert tuples(cut) == sorted([(i, t or "", x) for i, t, x in want], key=str)
    taken = corpus_pipeline.mixing(spark, cut, "").collect()
    assert len(taken) == len({(r.doc_id, r.text) for r in taken}) and all(r.size == len(r.text.split()) for r in taken)


def test_near_duplicates_of_null_ids(spark):
    """Two null ids are two nodes: what copies one goes for its sake, and each null id stays."""
    import random

    rng = random.Random(15)
    a, b = sentence(rng, 40), sentence(rng, 40)
    rows = [(None, a), (None, b), (1, b), (2, edited(rng, b.split(" "), 0)), (3, edited(rng, a.split(" "), 0))]
    found = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.component_id, r.kept) for r in found) == [(0, None, True), (0, None, True), (1, None, False), (2, None, False), (3, None, False)]


def test_language_stage_rejects_only_texts_without_letters(spark):
    """A text that fits two languages alike stays, and so do all where no label can be learned from."""
    rows = [(i, f"{w} common", w, "s", 1) for i, w in enumerate(["abc", "xyz"] * 6)] + [(50, "common", None, "s", 1), (51, "12 !", "abc", "s", 1), (None, None, "abc", "s", 0), (None, "common", None, "s", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    scores = {(r.doc_id, r.lettered): r.score for r in langid.identify_languages(docs).collect()}
    assert scores[50, True] == 0.0  # a tie
    want = sorted((r[0] if r[0] is not None else -1, r[1]) for r in rows if r[1] and "1" not in r[1])
    for some in (docs, docs.withColumn("lang", F.lit(None).cast("string"))):
        left = corpus_pipeline.language(spark, some, "")
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in left.collect()) == want


def test_rare_boilerplate_of_a_large_host_is_cut(spark):
    """A notice on 100 of 2400 pages is below a twentieth of them, but its entropy is log 100 / log 2400 = 0.59."""
    page = "<html><body><div class='text'><p>Words {n} of page {n}</p></div>{more}</body></html>"
    more = "<div class='box'><p>The same season greeting</p></div>"
    rows = [(i, f"http://a.example/{i}", page.format(n=f"w{i}", more=more if i % 24 == 0 else "")) for i in range(2400)]
    found = html_tree.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in found.collect()} == {i: f"Words w{i} of page w{i}" for i in range(2400)}


def tree_by_hand(pages: dict[int, str], presentation: float = 0.1, times: float = html_tree.TIMES) -> dict[int, tuple]:
    """By how much nodes of one host lie below its threshold, by own contents and by branch, from the definitions over whole lists."""
    import math

    read = {}
    for k, html in pages.items():
        blocks = html_tree.read_page(html).blocks
        read.setdefault(tuple(b.text for b in blocks if not b.element.apart), (k, blocks))
    m = len(read)
    below, shown, words, styles = {}, {}, {}, {}
    for k, blocks in read.values():
        held = {}
        for b in blocks:
            at = b.element
            while at is not None:
                held[at.node] = at
                below.setdefault(at.node, set()).add(b.element.node)
                at = at.above()
            for f, weight in html_tree.features(b.text):
                shown.setdefault(b.element.node, {}).setdefault(f, set()).add(k)
                words[b.element.node, f] = weight
        for node, e in held.items():
            styles.setdefault(node, []).append(tuple(e.children))

    def sums(leaves):
        parts = [(len(x) * words[n, f], math.log(len(x)) / math.log(m) * (m - 1) / (m + 1)) for n in leaves for f, x in shown[n].items()]
        return sum(w * e for w, e in parts), sum(w for w, _ in parts)

    lost, total = sums(shown)
    loss = min(max(times * lost / total, html_tree.LEAST_LOSS), html_tree.MOST_LOSS)
    out = {}
    for node, leaves in below.items():
        n = [styles[node].count(x) for x in set(styles[node])]
        entropy = -sum(x / sum(n) * math.log(x / sum(n)) for x in n) / math.log(m)
        lost, total = sums(leaves)
        branch = loss - lost / total + presentation * entropy
        own = None
        if node in shown:
            lost, total = sums([node])
            own = loss - lost / total
        if min(branch, own or 0) < 0:
            out[node] = (own if own is not None and own < 0 else None, branch if branch < 0 else None)
    return out


def test_tree_decides_inside_articles_and_without_them(spark):
    """Against importance worked out by hand; without the tree the template's blocks would stay."""
    one = "<html><body><div class='top'><p>Welcome to the site</p><p>{n} visitors</p></div><article><h1>Title {n}</h1><p>Words {n} of the text</p><div class='more'><p>Sign our petition</p></div></article></body></html>"
    two = "<html><body><div class='top'><div class='in'><p>All rights to us</p></div><p>Call now</p></div><div class='text'><p>Story {n} begins</p><p>and {n} ends</p>{extra}</div><div class='low'><p>Same {k}</p></div></body></html>"
    pages = {i: one.format(n=f"w{i}") for i in range(9)}
    other = {100 + i: two.format(n=f"s{i}", k=i % 2, extra="<p>Once more</p>" if i % 3 == 0 else "") for i in range(12)}
    rows = [(i, "http://a.example/x", h) for i, h in pages.items()] + [(i, "http://b.example/y", h) for i, h in other.items()]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_tree.extract_main_text(docs).collect()}
    for group in (pages, other):
        low = tree_by_hand(group)
        assert low and {i: found[i] for i in group} == {i: "\n".join(html_tree.main_blocks(html_tree.read_page(h), low)) for i, h in group.items()}
        assert all(found[i] != "\n".join(html_tree.main_blocks(html_tree.read_page(h), {})) for i, h in group.items())
    assert found[3] == "Title w3\nWords w3 of the text"
    assert found[104] == "Story s4 begins\nand s4 ends" and found[103] == "Story s3 begins\nand s3 ends\nOnce more"


def scrubbed(page: str) -> str:
    """A page whose tags and classes tell nothing of its parts."""
    import re
    import zlib

    page = re.sub(r"<(/?)(article|nav|footer|header|aside|form|section|main)\b", r"<\1div", page)
    return re.sub(r'class="([^"]*)"', lambda m: "class='x" + "".join(chr(97 + int(c)) for c in str(zlib.crc32(m[1].encode()))) + "'", page)


def test_tree_tells_articles_of_pages_without_names(spark):
    """On hosts of 30 pages or more every block of the articles stays and nine tenths of the others go, by the tree alone."""
    import re
    from collections import Counter

    host = F.regexp_extract("url", "//([^/]+)", 1)
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").withColumn("host", host)
    large = pages.groupBy("host").count().where("count >= 30").select("host")
    rows = [(r.page_id, r.url, scrubbed(r.html), r.html) for r in pages.join(large, "host").collect()]
    found = {r.page_id: Counter(r.text.split("\n")) for r in html_tree.extract_main_text(spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").repartition(4)).collect()}
    others = stayed = 0
    for i, _, page, given in rows:
        article = Counter(b.text for b in html_tree.read_page(re.search(r"<article>.*?</article>", given, re.S)[0]).blocks)
        rest = Counter(b.text for b in html_tree.read_page(page).blocks) - article
        assert not article - found[i]
        others, stayed = others + rest.total(), stayed + (rest & found[i]).total()
    assert len(rows) > 1000 and others > 10_000 and stayed < 0.1 * others


def test_deep_pages_take_memory_by_length():
    """Nested tags with text at each level, unclosed and with end tags of nothing: twice the depth takes about twice the memory."""
    import time
    import tracemalloc

    import pyarrow as pa

    peaks = []
    for n in (4000, 8000):
        page = "<div class='a b'>x" * n + "</i>" * n + "<b class='c'>y" * n
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([page])], ["host", "row", "text"])
        tracemalloc.start()
        began = time.time()
        (seen,) = html_tree.observed(iter([batch]))
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(seen.column("nodes")[0]) >= n and time.time() - began < 30
        assert html_tree.main_blocks(html_tree.read_page(page), {})
    assert peaks[1] < 2.5 * peaks[0]


def test_sums_of_branches_of_any_depth(spark):
    """A chain of 100 nodes with a twig at each, in two hosts."""
    above = [(h, k, k - 1 if k else None) for h in (1, 2) for k in range(100)] + [(1, 1000 + k, k) for k in range(100)]
    leaves = [(1, 1000 + k, 0.5 * k, 1) for k in range(100)] + [(2, 99, 1.0, 7)]
    found = html_tree.summed_branches(spark.createDataFrame(leaves, "host long, node long, lost double, shown long"), spark.createDataFrame(above, "host long, node long, above long"))
    sums = {(r.host, r.node): (r.lost, r.shown) for r in found.collect()}
    assert all(sums[1, k] == (sum(0.5 * j for j in range(k, 100)), 100 - k) and sums[2, k] == (1.0, 7) for k in range(100))
    assert sums[1, 1040] == (20.0, 1)


def test_pipeline_end_to_end(spark, tmp_path):
    """All five stages against plain re-statements of each, one after the other."""
    import random

    import duckdb
    import pandas as pd
    from cases import ordinary

    from tracemill.llm import mixing

    rng = random.Random(31)
    items = [(k, sentence(rng, n)) for k, n in enumerate([12, 30, 4])]
    rows = ordinary(31, 80) + [(100 + k, f"{sentence(rng, 30)} {t} {sentence(rng, 5)}", "en", "src1", 1) for k, t in items] + [(110, "123 456", "en", "src2", 1), (111, None, "en", "src2", 0)]
    passage = sentence(rng, 60)
    rows += [(120 + k, f"{sentence(rng, 40)} {passage} {sentence(rng, 40)}", "en", f"src{k % 4}", 1) for k in range(6)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    unlike = near(left, 5)
    left = sorted(r for r in left if unlike[r[0]][2])
    seen, cut = set(), []
    for r in left:
        data = r[1].encode()
        gone = bytearray(len(data))
        for s in range(len(data) - 99):
            if data[s : s + 100] in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(data[s : s + 100])
        cut.append((r[0], bytes(c for c, g in zip(data, gone, strict=True) if not g).decode(), *r[2:]))
    assert [r[1] for r in cut] != [r[1] for r in left]
    dirty = brute.contamination([(r[0], r[1]) for r in cut], items)
    clean = [r for r in cut if not dirty[r[0]][4]]
    assert len(clean) < len(cut) < len(rows) - 2
    documents = pd.DataFrame(clean, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841  the SQL reads it
    with duckdb.connect() as db:
        mix = {i: (size, taken) for i, size, taken in db.execute(f"SELECT doc_id, size, taken FROM ({mixing.ORACLE}) WHERE taken > 0").fetchall()}
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.text, r.size, r.taken) for r in found} == {r[0]: (r[1], *mix[r[0]]) for r in clean if r[0] in mix} and len(found) == len(mix)
