"""Near copies, decontamination, archives, URLs, extraction, chat and the pipeline against plain versions or SQL."""

import itertools
import random
import re

import numpy as np
import public_tokenizers
import pyarrow.fs as pafs
import pytest
import tiktoken
import xxhash
import zstandard

import corpus_pipeline
from gavilla.llm import catalog, chat, decontaminate, extraction, oracles, simhash, urls, warc
from gavilla.operators.components import connected_components  # noqa: F401  the helper that simhash uses
from gavilla.session import materialise
from tests.compare import connect, differences
from tests.llm.frames import PROSE, TEXTS, documents


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_query_equals_sql(spark, sf, name):
    found = catalog.queries()[name](spark, sf).toPandas()
    assert differences(found, connect(sf).execute(oracles.ORACLES[name]).df()) == ""


# -- near copies --------------------------------------------------------------------------------------


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """Smallest id that each (id, fingerprint) reaches over 3 or fewer differing bits."""
    least = {i: i for i, _ in fps}
    find = lambda x: x if least[x] == x else find(least[x])
    for (i, a), (j, b) in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= 3:
            i, j = find(i), find(j)
            least[max(i, j)] = min(i, j)
    return {i: find(i) for i, _ in fps}


def test_near_copy_query(spark, sf):
    found = catalog.op6_simhash_near_dedup(spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    fps = [(i, plain_fingerprint(t)) for i, t in zip(docs.doc_id, docs.text)]
    assert {i: f"{fp:016x}" for i, fp in fps} == found.fingerprint.to_dict()
    assert plain_components(fps) == found.component_id.to_dict()


@pytest.mark.parametrize("block", [4096, 100])
def test_links_connect_all_within_three_bits(spark, block):
    """A hot ball of fingerprints, chains and strangers, with and without cutting the buckets into blocks."""
    rng = np.random.default_rng(1)
    values = [int(x) for x in rng.integers(0, 2**63, 150).astype(np.uint64)]
    for source, count in ((values[0], 500), (None, 200)):
        for _ in range(count):
            x = source if source is not None else values[rng.integers(len(values))]
            for b in rng.integers(0, 64, rng.integers(1, 6)):
                x ^= 1 << int(b)
            values.append(x)
    values = sorted(set(values))
    signed = {int(np.uint64(v).astype(np.int64)): k for k, v in enumerate(values)}
    frame = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    edges = simhash.links(frame, 3, block).collect()
    assert len(edges) < 4 * len(values) * (1 if block > 1000 else 20)
    assert all((values[signed[e.a]] ^ values[signed[e.b]]).bit_count() <= 3 for e in edges)
    wanted = plain_components(list(enumerate(values)))
    least = {k: k for k in range(len(values))}
    find = lambda x: x if least[x] == x else find(least[x])
    for e in edges:
        a, b = find(signed[e.a]), find(signed[e.b])
        least[max(a, b)] = min(a, b)
    assert {k: find(k) for k in least} == wanted


def test_allowances_cover_every_pair():
    """Whatever the dynamic programme picks, the allowances add up as the principle asks."""
    rng = np.random.default_rng(2)
    bits = rng.random((2000, 64)) < rng.random(64)
    bits[:, 5] = bits[:, 9]
    both = (bits.T.astype(float) @ bits) * 1e4
    for parts in range(1, 7):
        _, chosen = simhash.allot(2000 * 10_000, both, 3, parts)
        assert sum(a for _, a in chosen) == 3 - parts + 1
        assert sorted(b for group, _ in chosen for b in group) == list(range(64))
    assert any({5, 9} <= set(group) for group, _ in simhash.allot(2000 * 10_000, both, 3, 4)[1])


def test_near_copies_on_awkward_rows(spark):
    docs = documents(spark)
    rows = simhash.near_copies(docs).collect()
    assert len(rows) == len(TEXTS)
    by_id = {r.doc_id: r.component_id for r in rows}
    assert (by_id[1], by_id[2], by_id[11]) == (1, 1, 1)
    assert (by_id[3], by_id[4], by_id[5]) == (3, 3, 3)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 2 not in ids and 4 not in ids and None in ids
    again = simhash.keep_one(docs.where("doc_id = 2")).collect()
    assert [r.doc_id for r in again] == [2]
    assert simhash.near_copies(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


# -- decontamination ------------------------------------------------------------------------------------

QUESTION = "Yesterday Alice Smith had 12 apples. Then Bob gave Alice 3.5 kg more, so Alice carried 12 miles of them to Bob again."


def test_templates(spark):
    items = spark.createDataFrame([(1, QUESTION), (2, "too short"), (3, "one two three four five"), (4, None), (None, PROSE), (1, QUESTION)], "item_id bigint, text string")
    changed = QUESTION.replace("Alice", "Carol").replace("Smith", "Jones").replace("Bob", "Dan").replace("12", "77").replace("3.5", "9")
    mixed = changed.replace("so Carol", "so Erin").replace("77 miles", "78 miles").replace("to Dan", "to Paul")
    docs = documents(
        spark,
        [(1, "x y. " + QUESTION + " z"), (2, changed), (3, mixed), (4, "say one two three four five now"), (5, None), (6, ""), (7, PROSE),
         (8, "One. Two THREE,\nfour five"), (None, QUESTION), (2, changed), (9, QUESTION + " " + changed), (10, QUESTION.replace(" ", "\n  "))],
    )
    found = {(r.doc_id, r.item_id): r.changed for r in decontaminate.matches(docs, items).collect()}
    assert found == {(1, 1): False, (2, 1): True, (4, 3): False, (8, 3): False, (9, 1): True} | (
        {(10, 1): False} if (10, 1) in found else {}
    )
    kept = decontaminate.drop_leaks(docs, items)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {3, 5, 6, 7, None}
    assert not {r.doc_id for r in kept.collect()} & {1, 2, 4, 8, 9}
    assert decontaminate.matches(docs.limit(0), items).count() == 0
    assert decontaminate.matches(docs, items.limit(0)).count() == 0


def test_wrapped_and_partly_changed_passages(spark):
    """Line breaks before names change nothing, and windows without slots count though the slots contradict each other."""
    words = "the water of the long river ran down to the old mill where people came with wheat in spring and waited for flour"
    passage = f"There were 40 sacks and again 40 sacks; {words}"
    items = spark.createDataFrame([(1, passage), (2, QUESTION)], "item_id bigint, text string")
    docs = documents(spark, [(1, passage.replace("again 40", "again 41")), (2, QUESTION.replace(" Alice", "\nAlice").replace(" Bob", "  \r\n Bob"))])
    found = {(r.doc_id, r.item_id): r.changed for r in decontaminate.matches(docs, items).collect()}
    assert found == {(1, 1): False, (2, 2): False}


def test_large_benchmark_is_joined_by_shuffle(spark, sf, monkeypatch):
    wanted = catalog.op2_benchmark_decontamination(spark, sf).toPandas()
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    assert differences(catalog.op2_benchmark_decontamination(spark, sf).toPandas(), wanted) == ""


# -- archives -----------------------------------------------------------------------------------------

PAGES = [
    (1, "http://a.example/x", "<p>same</p>"), (2, "http://b.example/", "<p>same</p>"), (2, "http://b.example/", "<p>same</p>"),
    (3, None, None), (4, "", ""), (5, "no scheme", "x" * 700_000), (None, "http://c.example/\r\nEvil: 1", "<p>same</p>"),
    (6, "http://d.example/é?q=1#f", "ünï " * 50), (7, "HTTP://E.Example", "other"),
]


def pages_frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1, "mine") for r in rows], "page_id bigint, url string, html string, refers_to int, text string")


def test_archive_round_trip(spark, tmp_path):
    pages = pages_frame(spark)
    rows = warc.round_trip(pages).collect()
    assert len(rows) == len(PAGES)
    for row in rows:
        same = row.page_id in (1, 2, None)
        html = "<p>same</p>" if same else next(h or "" for i, _, h in PAGES if i == row.page_id)
        assert (row.payload_bytes, row.payload_digest) == (len(html.encode()), warc.digest(html.encode()))
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in rows)
    assert kinds == [(0, "response", None), (1, "response", None), (2, "revisit", 1), (2, "revisit", 1), (3, "response", None),
                     (4, "revisit", 3), (5, "response", None), (6, "response", None), (7, "response", None)]
    assert warc.round_trip(pages.limit(0)).count() == 0
    # Whole files: the plain stream holds every record, the seek table leads to each frame, and one record costs one frame.
    index, folder = warc.archive(pages, str(tmp_path / "bundles"), bundle_bytes=200_000)
    names = sorted(p.name for p in (tmp_path / "bundles").iterdir())
    assert len(names) > 1 and all(re.fullmatch(r"bundle-\d{6}\.warc\.zst", n) for n in names)
    records = 0
    for name in names:
        data = (tmp_path / "bundles" / name).read_bytes()
        plain = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
        with pafs.LocalFileSystem().open_input_file(str(tmp_path / "bundles" / name)) as file:
            frames = warc.read_seek_table(file)
        assert sum(size for *_, size in frames) == len(plain)
        records += plain.count(b"WARC/1.1\r\nWARC-Type")
    assert records == len(PAGES)
    one = warc.read_records(index.where("page_id = 6"), folder).collect()
    assert [(r.page_id, bytes(r.payload).decode()) for r in one] == [(6, "ünï " * 50)]
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, None, b"abc", None).replace(b"abc", b"abd"))


# -- urls -----------------------------------------------------------------------------------------------


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for rule, verdict in urls.RULES:
        domain, start = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start) and len(rule) > len(best[0] if best else ""):
            best = rule, verdict
    return host, path, *(best or (None, None))


def test_url_query(spark, sf):
    found = catalog.op7_url_filter(spark, sf).toPandas().set_index("page_id")
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    assert len(found) == len(pages)
    for page_id, url in zip(pages.page_id, pages.url):
        row, (host, path, rule, verdict) = found.loc[page_id], plain_rule(url)
        assert (row.host, row.path) == (host, path) and (row.rule or None) == rule
        assert row.verdict == verdict if rule else row.verdict in ("allow", "block")


def test_url_models_equal_plain_counts(spark):
    """The hashed tables give what counting contexts in dictionaries gives."""
    rng = random.Random(4)
    words = {True: ["news", "wiki", "docs"], False: ["casino", "bets", "win"]}
    rows = [("".join(rng.choice(words[k]) + rng.choice("/-.") for _ in range(4)), k) for k in (True, False) * 150]
    tables = urls.count_models(spark.createDataFrame(rows, "url string, accepted boolean"))
    counts = {True: {}, False: {}}
    for text, kind in rows:
        data = b"\0" * urls.ORDER + text.encode()
        for i in range(urls.ORDER, len(data)):
            for k in range(urls.ORDER + 1):
                for gram in (("c", data[i - k : i]), ("g", data[i - k : i + 1])):
                    counts[kind][k, gram] = counts[kind].get((k, gram), 0) + 1

    def plain(text):
        data, total = b"\0" * urls.ORDER + text.encode(), 0.0
        for kind, sign in ((True, 1), (False, -1)):
            for i in range(urls.ORDER, len(data)):
                p = 1 / 256
                for k in range(urls.ORDER + 1):
                    g, c = (counts[kind].get((k, x), 0) for x in (("g", data[i - k : i + 1]), ("c", data[i - k : i])))
                    p = (g + urls.STRENGTH * p) / (c + urls.STRENGTH)
                total += sign * np.log(p)
        return total / max(len(text.encode()), 1)

    texts = ["news/wiki", "bets-win", "", "docs.casino", "é"]
    texts += ["".join(rng.choice(words[rng.random() < 0.5]) + rng.choice("/-.") for _ in range(3)) for _ in range(60)]
    off = np.abs(urls.difference(texts, tables) - [plain(t) for t in texts])
    assert np.quantile(off, 0.8) < 1e-5 and off.max() < 0.5  # now and then two grams share a slot


def test_urls_on_awkward_rows(spark):
    odd = [(1, "x://Org/"), (2, "http://a.ORG"), (3, None), (4, ""), (5, "://"), (6, "http://www.example.org/en/12?x"), (7, "a://b.com/de/://c"),
           (8, "http://x.net/" + "a" * 50_000), (8, "http://x.net/q"), (None, "http://net/#")]
    pages = pages_frame(spark, [(i, u, "") for i, u in odd])
    rows = urls.verdicts(pages).collect()
    assert sorted((r.page_id or 0, r.host, r.path, r["rule"] or "") for r in rows) == sorted(
        (i or 0, *plain_rule(u)[:2], plain_rule(u)[2] or "") for i, u in odd
    )
    assert urls.verdicts(pages.limit(0)).count() == 0
    assert urls.judge(pages).columns == [*pages.columns, "url_verdict"]


# -- extraction ---------------------------------------------------------------------------------------


def test_extraction_query(spark, sf):
    """Every page of the table marks its article; its text is read off here in a plain way."""
    import html as entities

    found = catalog.op3_html_extraction(spark, sf).toPandas().set_index("page_id")
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    assert len(found) == len(pages)
    for page_id, source in zip(pages.page_id, pages.html):
        article = source.split("<article>")[1].split("</article>")[0].split("<footer>")[0]
        wanted = []
        for part in re.split(r"</?(?:p|h1)[^>]*>?", article):
            text = " ".join(entities.unescape(re.sub(r"<[^>]*(?:>|$)", " ", part)).split())
            wanted += [text] if text else []
        row = found.loc[page_id]
        assert row.text == "\n".join(wanted) and row.n_chars == len(row.text)


def test_main_text_of_broken_and_rich_pages():
    page = """<html><body><header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav><div id=main class="content">
    <h2>T&amp;A</h2><p>One <b>two<p>Three&nbsp;four<div class="cookie-notice">We use cookies</div><ul><li>a<li>b</ul>
    <table><tr><td>x<td>y</table></div><aside>side</aside><div class="comments"><p>nice</div><form>f<input></form>
    <script>var a="</p><p>no";</script><style>p{}</style><!-- <p>no --><footer>c"""
    assert extraction.main_text(page) == "T&A\nOne two\nThree four\na\nb\nx\ny"
    article = '<p>before</p><article><header><h1>T</h1></header><p>x<span class=ad>no</span>y<br>z</p><section class="comments"><p>c</p></section></article>'
    assert extraction.main_text(article) == "T\nxy z"
    for odd in (None, "", "plain < text", "<", "<p", "<p class='", "</div></p>", "<!--", "<script>never ends", "&a &amp &#x41;", "<p>" * 3000):
        extraction.main_text(odd)
    assert extraction.main_text("a &lt;b&gt; &#x41;") == "a <b> A"


def test_names_of_wrappers_do_not_empty_a_page():
    inside = "<h1>T</h1><p>one two three</p><div class=comments><p>nice</p></div>"
    for page in (
        f"<body class='has-sidebar'><article>{inside}</article></body>", f"<html class='nav-closed'><body class=sidebar><main>{inside}</main>",
        f"<div id='content-with-sidebar'><article>{inside}</article></div>", f"<article class='post comments-open'>{inside}</article>",
        f"<main class='search-results'>{inside}</main>", f"<main class='search'>{inside}</main>", f"<div class=widget>{inside}</div><p>end</p>",
        f"<div class='sidebar'><p>side</p></div><div class=widget><article>{inside}</article></div>",
    ):
        assert extraction.main_text(page).replace("\nend", "") == "T\none two three"
    long = "<p>said by a reader</p>" * 50
    for mark in ("class='ad-1'", "id=cookie-notice", "role=navigation", "class='x sidebar'"):
        assert extraction.main_text(f"<div {mark}>{long}</div><article>{inside}</article>") == "T\none two three"


def test_style_trees_remove_what_a_site_repeats(spark):
    rng = random.Random(6)
    say = lambda: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") * 3 for _ in range(12))
    rows, wanted = [], {}
    for i in range(40):
        body = [say() for _ in range(3)]
        wanted[i] = "\n".join(body)
        rows.append((i, f"http://site.example/{i}", f"<body><div class=x1><p>Our shop is open</p><p>Call us now</p></div><div class=x2>{''.join(f'<p>{b}</p>' for b in body)}</div><div class=x3>All about us</div></body>"))
    rows += [rows[0], (None, None, None), (90, "http://lone.example/", "<body><div class=x2><p>lone</p></div></body>")]
    pages = pages_frame(spark, rows)
    found = extraction.page_texts(pages).collect()
    assert len(found) == len(rows)
    assert {r.page_id: r.text for r in found if r.page_id in wanted} == wanted
    assert {r.text for r in found if r.page_id == 90} == {"lone"} and {r.text for r in found if r.page_id is None} == {""}
    assert extraction.page_texts(pages.limit(0)).count() == 0


@pytest.mark.parametrize("chars", [extraction.BROADCAST_CHARS, 0])
def test_style_trees_judge_inside_and_outside_articles(spark, monkeypatch, chars):
    """What a site repeats inside its articles goes; main text in a div stays where teasers are the articles."""
    monkeypatch.setattr(extraction, "BROADCAST_CHARS", chars)
    rng = random.Random(7)
    say = lambda: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(12))
    frame, wanted = [], {}
    for i in range(40):
        text = say()
        wanted[i] = text
        frame.append((i, f"http://news.example/{i}", f"<body><div class=y>Follow us</div><article><p>{text}</p><div class=z1><p>Join our list</p></div></article></body>"))
        wanted[100 + i] = text
        teasers = "<div class=t><article><p>Read this too</p></article><article><p>And this</p></article></div>"
        frame.append((100 + i, f"http://shop.example/{i}", f"<body><div class=m><p>{text}</p></div>{teasers}</body>"))
        wanted[200 + i] = "always said"  # one page under many addresses is not boilerplate
        frame.append((200 + i, f"http://copy.example/{i}", "<body><article><p>always said</p></article></body>"))
    found = extraction.page_texts(pages_frame(spark, frame)).collect()
    assert {r.page_id: r.text for r in found} == wanted


# -- chat -----------------------------------------------------------------------------------------------

TURNS = [
    (1, 0, "user", "How do I sort a list?\nIt is long."), (1, 1, "assistant", "Use sorted()."), (1, 2, "user", "And backwards?"),
    (1, 3, "assistant", "user wrote:\n> How do I sort a list?\n> IT is long\nWith a key, too."),
    (1, 4, "user", "> > How do I sort a list?\n> With a key, too.\nThanks"), (1, 5, None, "> nobody said this"), (1, 7, "user", "> And backwards?"),
    (2, 0, "user", None), (2, 1, "user", ""), (None, 0, "user", "lost"), (3, None, "user", "lost"), (1, 2, "user", "And backwards?"),
    (4, 5, "user", "> Use sorted()."),
]


def turns_frame(spark, rows=TURNS):
    return spark.createDataFrame([(*r, "mine", 3) for r in rows], "conv_id bigint, turn bigint, role string, text string, parent string, level int")


def test_quotations_are_linked(spark):
    rows = chat.reply_ordered(turns_frame(spark)).collect()
    assert len(rows) == len(TURNS)
    found = {(r.conv_id, r.turn): r for r in rows}
    assert {k[1]: r.reply_to for k, r in found.items() if k[0] == 1} == {0: None, 1: 0, 2: 1, 3: 0, 4: 3, 5: 4, 7: 2}
    assert {k[1]: (r.thread, r.depth) for k, r in found.items() if k[0] == 1} == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (0, 1), 4: (0, 2), 5: (0, 3), 7: (0, 3)}
    assert found[1, 3].text == "With a key, too." and found[1, 4].text == "Thanks"
    assert (found[1, 4].n_quotes, found[1, 4].quote_levels, found[1, 4].n_linked) == (2, 2, 2)
    assert found[1, 5].message == "<|user|>\n\n<|end|>"
    assert (found[4, 5].reply_to, found[4, 5].depth, found[3, None].depth) == (None, 0, None)
    assert chat.reply_ordered(turns_frame(spark).limit(0)).count() == 0


def test_quotations_equal_sql(spark, tmp_path):
    """Random conversations with quotes, the query's SQL beside them."""
    import duckdb

    rng, rows = random.Random(8), []
    for c in range(30):
        said = []
        for t in range(rng.randint(1, 12)):
            lines = [f"{rng.choice('abcdef')} {rng.choice('ghi')}!" for _ in range(rng.randint(1, 3))]
            if said and rng.random() < 0.6:
                lines[:0] = ["X wrote:", *(rng.choice(["> ", ">> ", "> > "]) + rng.choice(said) for _ in range(rng.randint(1, 4)))]
            said += lines[-1:]
            rows.append((c, t, rng.choice(["user", "assistant"]), "\n".join(lines)))
    frame = materialise(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), "turns")
    con = duckdb.connect()
    con.register("conversations", frame.toPandas())
    assert differences(chat.reply_ordered(frame).toPandas(), con.execute(oracles.CHAT).df()) == ""


# -- the pipeline -----------------------------------------------------------------------------------------


def test_pipeline_equals_plain_stages(spark, sf):
    """Each stage's decisions are applied here to the whole table in memory, one after the other."""
    from gavilla.llm import quality, toxicity
    from gavilla.llm.common import table

    found = corpus_pipeline.run(spark, sf).toPandas().set_index("doc_id")
    docs = table(spark, sf, "documents")
    labels = table(spark, sf, "labels")
    texts = docs.toPandas().set_index("doc_id").text
    kept = {r.doc_id for r in quality.verdicts(docs, labels).collect() if r.kept}
    left = spark.createDataFrame([(i, texts[i]) for i in sorted(kept)], "doc_id bigint, text string")
    kept = {r.doc_id for r in toxicity.score(left, labels).collect() if not r.predicted}
    parts = plain_components([(i, plain_fingerprint(texts[i])) for i in sorted(kept)])
    kept = {i for i in kept if parts[i] == i}
    con = connect(sf)
    leaks = {i for (i,) in con.execute(f"SELECT DISTINCT doc_id FROM ({oracles.LEAKS})").fetchall()}
    kept -= leaks
    assert set(found.index) == kept
    ranks = __import__("gavilla.llm.tokens", fromlist=["Codec"]).Codec(public_tokenizers.path(catalog.RANKS), public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for doc_id, row in found.iterrows():
        assert np.frombuffer(row.ids, dtype="<u4").tolist() == library.encode_ordinary(texts[doc_id])


def test_pipeline_stages_keep_columns(spark, sf):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
