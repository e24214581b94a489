"""Sharding, page text and language-model scores."""

from __future__ import annotations

import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from granary.llm.common import slices_of
from granary.llm.page_text import best_path, host_paths, page_texts, parse, text_under
from granary.llm.pseudo_likelihood import PAD, Network, WordIds, fitted, pseudo_likelihood, score, train, windows
from granary.llm.sharding import Node, even_tree, place, shard_documents, with_region
from .conftest import texts


@pytest.mark.parametrize("table", ["odd_table", "documents", "none"])
def test_every_row_has_a_shard_and_a_slot(table, request):
    df = request.getfixturevalue(table)
    found = shard_documents(df).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.law) for r in found) == Counter(
        (i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), "key") for i, t in texts(df)
    )
    slots = {}
    for r in found:
        assert 0 <= r.shard <= 15 and r.grown_shard in (r.shard, 16)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({(r.doc_id, r.shard, r.grown_shard) for r in found}) == len({r.doc_id for r in found})
    plan = shard_documents(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_shares_follow_weights_and_changes_stay_in_their_subtree(spark):
    keys = spark.range(40_000)
    tree = even_tree()
    heavy = Node("root", children=(
        Node("region-0", children=(Node("rack-0", children=(Node("a", 1, 0), Node("b", 1, 1))), Node("rack-1", children=(Node("c", 2, 2),)))),
        Node("region-1", children=(Node("rack-2", children=(Node("d", 4, 3),)),)),
    ))
    lighter = Node("root", children=(
        Node("region-0", children=(Node("rack-0", children=(Node("a", 1, 0), Node("b", 0.5, 1))), heavy.children[0].children[1])),
        heavy.children[1],
    ))
    row = keys.select(
        "id", place(keys.id, tree).alias("t"), place(keys.id, with_region(tree, 16, 2.0)).alias("g"),
        place(keys.id, heavy).alias("h"), place(keys.id, lighter).alias("l"),
    ).toPandas()
    assert row.t.value_counts().between(2200, 2800).all() and set(row.t) == set(range(16))
    moved = row[row.t != row.g]
    assert set(moved.g) == {16} and 0.09 < len(moved) / len(row) < 0.13
    share = row.h.value_counts(normalize=True)
    assert [round(share[k], 1) for k in range(4)] == [0.1, 0.1, 0.2, 0.5] or abs(share[2] - 0.25) < 0.02
    changed = row[row.h != row.l]
    assert len(changed) and not ((changed.h == 3) | ~changed.h.isin([0, 1, 2])).any()
    with pytest.raises(ValueError):
        place(keys.id, Node("root", children=(Node("x", 0, 1),)))


PAGE = """<!doctype html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>
<div id="sidebar"><p>{side}</p></div><div class="wrap"><article class="post-{n}"><header><h1>Title &amp; more</h1></header>
<p>First   <b>bold</b><br>text &eacute;&#33;<p>Second<!-- c --> paragraph {n}.<ul><li>one<li>two</ul>
<form><label>Mail</label><input></form><div class="share-bar">Share</div><p style="display: none">hidden</p>
<section class="comments"><p>Reader says</p></section><aside>Aside</aside></article></div>
<div class="cookie-notice">We use cookies</div><div class="ad">Buy</div><footer>Foot</footer>"""
TEXT = "Title & more\n\nFirst bold text é!\n\nSecond paragraph {n}.\n\none\n\ntwo"


def test_article_text_alone_remains(spark):
    rows = [(k, f"https://Host.example:80/{k}", PAGE.format(n=k, side="s")) for k in range(4)]
    odd = [(9, None, None), (9, None, None), (None, "not a url", ""), (10, "http://x", "<p>a < b<p>c"), (11, "http://y", "plain &lt;text&gt;"), (12, "http://z", "<div><script>x")]
    pages = spark.createDataFrame([(*r, "h", "p") for r in rows + odd], "page_id bigint, url string, html string, host string, path string")
    found = page_texts(pages).collect()
    assert Counter((r.page_id, r.text) for r in found) == Counter(
        [(k, TEXT.format(n=k)) for k in range(4)]
        + [(9, ""), (9, ""), (None, ""), (10, "a < b\n\nc"), (11, "plain <text>"), (12, "")]
    )
    assert all(r.n_chars == len(r.text) for r in found)
    assert page_texts(pages.limit(0)).count() == 0


def test_the_host_outvotes_a_misleading_page(spark):
    good = "<body><div class='story-{n}'><p>{w}</p><p>{w}</p></div><div class='box'><p>small</p></div></body>"
    bad = "<body><div class='story-9'><p>short tale</p></div><div class='box'><p>{w}</p></div></body>"
    words = "many words of the article " * 10
    rows = [(k, "http://h/", good.format(n=k, w=words)) for k in range(3)] + [(3, "http://h/", bad.format(w=words))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert [r.path for r in host_paths(pages).collect()] == ["page>body>div.story"]
    assert {r.page_id: r.text for r in page_texts(pages).collect()}[3] == "short tale"
    page = parse(bad.format(w=words))
    assert text_under(page, best_path(page)) == words.strip()


LEAD, MUCH = "A lead sentence of the article. " * 6, "Many words of the article follow here. " * 50


@pytest.mark.parametrize(
    ("inner", "parts"),
    [
        ("<div id=main><h1>Title</h1><div class=lead>{0}</div><div class=text>{1}</div></div><div class=box>small</div>", "Title,0,1"),
        ("<div class=page><div class=one><p>{1}</div><div class=two><h2>More</h2><p>{0}<p>{0}</div></div>", "1,More,0,0"),
        ("<div><p>{0}<blockquote><p>{1}</blockquote><p>{0}</div>", "0,1,0"),
        ("<h1>Title</h1><div><p>{1}</div>", "Title,1"),
        ("<div class=x><p>{1}</div><div class=list><a href=a>{0}</a></div>", "1"),
        ("<div class=x><p>{1}</div><div class=imprint>{0}</div>", "1"),
    ],
)
def test_all_parts_of_an_article_stay(inner, parts):
    page = parse("<body>" + inner.format(LEAD, MUCH))
    named = {"0": LEAD.strip(), "1": MUCH.strip()}
    assert text_under(page, best_path(page)) == "\n\n".join(named.get(x, x) for x in parts.split(","))


@pytest.mark.parametrize("name", ["post-related", "content-ad", "main-sidebar", "article-newsletter", "post-share", "text promo"])
def test_noise_named_after_the_article_goes(name):
    for box in (f"<div class='{name}'><p>{LEAD}</div>", f"<p id='{name}'>{LEAD}</p>", f"<article class='{name}'>{LEAD}</article>", f"<span class='{name}'>{LEAD}</span>"):
        for around in ("article", "div class='content has-sidebar'", "div class='post-ad-free'", "div class='post no-ads'"):
            page = parse(f"<body><{around}><p>{MUCH}</p>{box}<p class='text with-ads'>end</p></{around.split()[0]}>")
            assert text_under(page, best_path(page)) == MUCH.strip() + "\n\nend"
    page = parse(f"<div class='{name}'><p>{MUCH}</div>")
    assert text_under(page, best_path(page)) == MUCH.strip()


def test_a_page_of_another_layout_keeps_its_article(spark):
    usual = f"<body><div class=story><p>{MUCH}</div><div class=box><p>small</div>"
    other = f"<body><div class=story><p>A teaser.</div><div class=feature><p>{MUCH}</div>"
    rows = [(k, "http://h/", usual) for k in range(3)] + [(3, "http://h/", other), (4, "http://h/", other.replace("feature", "box"))]
    found = page_texts(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {**{k: MUCH.strip() for k in range(4)}, 4: "A teaser."}
    assert all(r.n_chars == len(r.text) for r in found)


@pytest.mark.parametrize(
    "start", ["<html><head><title>x</title><body>", "<html><head><title>x</title><meta a=b>", "<title>x</title>", "<head><style>p {}</style><br>"]
)
def test_an_open_head_ends_where_the_body_begins(start):
    for rest in ("<p>text", "text", "<div><p>text</div>"):
        page = parse(start + rest)
        assert text_under(page, best_path(page)) == "text"
    assert parse("<head><title>x</title><script>y</script><link a=b> ").blocks == []


@pytest.mark.parametrize(
    ("page", "parts"),
    [
        ("<body class='single comments-open'><article><h1>T</h1><p>{1}</article>", "T,1"),
        ("<body class='comments'><div class='post no-comments'><p>{1}</div>", "1"),
        ("<article class='post comments-closed'><p>{1}</article><article class='comment even'><p>{0}</article>", "1"),
        ("<article><header class='entry-header'><h1>T</h1></header><p>{1}</article>", "T,1"),
        ("<div class=post><header class='post-header'><h1>T</h1></header><p>{1}</div>", "T,1"),
        ("<article><div class='article-header'><h1>T</h1><p>{0}</div><p>{1}</article>", "T,0,1"),
        ("<main><h1 class='page-header'>T</h1><p>{1}</main>", "T,1"),
        ("<div class='main-header'><p>{0}</div><header class='masthead'>{0}</header><div class=x><p>{1}</div>", "1"),
        ("<form id=f><div class=nav>x</div><div class=a><h1>T</h1><p>{1}</div><input name=a></form>", "T,1"),
        ("<article><p>{1}</article><form><p>{0}</form>", "1"),
        ("<article><p>{1}<form><p>{0}</form></article>", "1"),
        ("<body><svg><title/><path d=x /></svg><article><p>{1}</article>", "1"),
        ("<body><svg><title>Logo</title></svg><math><mi/></math><article><p>{1}</article>", "1"),
        ("<article><p>{1}</p><a \"><p>end</p></article>", "1,end"),
        ("<article><p>{1}</p><a href=\"x><p>end</p></article>", "1,end"),
        ("<article><p title='a > b'>{1}</p><p>1 < 2 &lt; 3 <3</p></article>", "1,1 < 2 < 3 <3"),
        ("<article><p>{1}</p><a href='x", "1"),
    ],
)
def test_common_page_forms_keep_title_and_article(page, parts):
    found = parse(page.format(LEAD, MUCH))
    named = {"0": LEAD.strip(), "1": MUCH.strip()}
    assert text_under(found, best_path(found)) == "\n\n".join(named.get(x, x) for x in parts.split(","))


@pytest.mark.parametrize("unit", ['<a "', '<a ="', "<a x='", '<a x=">"', "<!", "<!--", "<?", "</p", "<a <", "= \"", "<a x= ", "<svg><title>", "<b>", "<div>", "<b></i>", "<b><div></div>"])
def test_hostile_markup_takes_linear_time(unit):
    began = time.perf_counter()
    parse("<p>text" + unit * (1_000_000 // len(unit)))
    assert time.perf_counter() - began < 20


def test_the_border_of_another_layout(spark):
    usual = "<body><div class=story><p>" + "w" * 200 + "</div>"
    rows = [(k, "http://h/", usual) for k in range(3)]
    rows += [(3 + k, "http://h/", f"<body><div class=story><p>{'s' * 30}</div><div class=f{'xy'[k]}><p>{'o' * n}</div>") for k, n in enumerate((60, 61))]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for other_layout, long in ((2.0, {4}), (1.9, {3, 4}), (2.1, set())):
        found = {r.page_id: r.text for r in page_texts(pages, other_layout).collect()}
        assert {k for k in (3, 4) if "o" in found[k]} == long


def test_deep_and_unclosed_pages_end():
    page = parse("<div>" * 3000 + "deep" + "<b>" * 3000)
    assert text_under(page, best_path(page)) == "deep"
    assert parse("<p>" * 20_000).blocks == []


def test_gradient_equals_differences():
    net = Network.fresh()
    net.flat += np.random.default_rng(0).normal(0, 0.05, net.flat.shape).astype(np.float32)
    context, target = np.array([[1, 2, 3, 4], [5, 6, 1, PAD]]), np.array([70, 9])
    found = net.gradient(context, target)
    for name in ("embed", "into", "bias", "klass", "member"):
        values, slope = getattr(net, name), getattr(found, name)
        k = np.unravel_index(np.argmax(abs(slope)), slope.shape)
        was, losses = values[k], []
        for step in (0.01, -0.01):
            values[k] = was + step
            losses.append(-net.log_probabilities(context, target).mean())
        values[k] = was
        assert slope[k] == pytest.approx((losses[0] - losses[1]) / 0.02, rel=0.01)


def test_probabilities_sum_to_one():
    net = Network.fresh()
    context = np.tile([[3, PAD, 8, 1]], (PAD, 1))
    assert np.exp(net.log_probabilities(context, np.arange(PAD))).sum() == pytest.approx(1, abs=1e-4)


def test_batches_share_memory_and_not_values():
    random = np.random.default_rng(1)
    large = random.integers(0, PAD, (5000, 4)), random.integers(0, PAD, 5000)
    small = large[0][:3], large[1][:3]
    net, plain = Network.fresh(), Network.fresh()
    net.gradient(*large)
    rooms = {name: room.ctypes.data for name, room in net._rooms.items()}
    assert np.array_equal(net.gradient(*small).flat, plain.gradient(*small).flat)
    sure = net.log_probabilities(*large)
    assert {name: room.ctypes.data for name, room in net._rooms.items()} == rooms
    logits = net.hidden(large[0])[1].astype(np.float64) @ net.klass
    wanted = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    own = np.einsum("nh,nhm->nm", net.hidden(large[0])[1].astype(np.float64), net.member[large[1] // 64])
    within = own - np.log(np.exp(own).sum(axis=1, keepdims=True))
    rows = np.arange(5000)
    assert sure == pytest.approx(wanted[rows, large[1] // 64] + within[rows, large[1] % 64], abs=1e-4)


def test_places_of_words_are_their_order_of_meeting():
    words = WordIds()
    assert words.places(b"b A b\ta  c").tolist() == [0, 1, 0, 1, 2]
    assert words.places(None).tolist() == [] and words.places(b"c d").tolist() == [2, 3]
    known = [(int(xxhash.xxh3_64_intdigest(w)) >> 12 << 12 | zlib.crc32(w) % PAD) for w in (b"b", b"a", b"c", b"d")]
    assert words.keys[:4].view(np.uint64).tolist() == known


ODD_TEXTS = [b" a B\tb\x0b\x0cA  ", None, b"", b"  ", b"\xff\xfe \xc3( x\x1cy\x85z\xa0q", "É é\u3000A\nb".encode(), b"b" * 300]


@pytest.mark.parametrize("texts", [ODD_TEXTS, ODD_TEXTS[1:4], [None], []])
def test_words_of_a_batch_are_looked_up_once(texts):
    batch = pa.RecordBatch.from_arrays([pa.array([b"before", *texts * 3], pa.binary()).slice(1)], ["text"])
    words, asked = WordIds(), []
    words.memory = type("Asked", (dict,), {"__getitem__": lambda self, w: asked.append(w) or self.setdefault(w, len(self))})()
    found = []
    for part in slices_of([batch], "text", rows=5, most=60):
        first = len(asked)
        places, numbers, sizes = words.places_of(part.column("text"))
        assert len(set(asked[first:])) == len(asked) - first == len(places)
        found += [places[numbers][end - n : end].tolist() for n, end in zip(sizes, np.cumsum(sizes))]
    plain = WordIds()
    assert found == [plain.places(t).tolist() for t in texts * 3]
    assert list(words.memory) == list(plain.memory)
    assert words.keys[: len(words.memory)].tolist() == plain.keys[: len(words.memory)].tolist()


def test_windows_see_both_sides_of_their_own_text_only():
    long = [k % 4001 for k in range(20_000)]
    found = [(tuple(c), t, o) for cs, ts, os in windows([[7, 8], [], long, [9]]) for c, t, o in zip(cs, ts, os)]
    assert found[:2] == [((PAD, PAD, 8, PAD), 7, 0), ((PAD, 7, PAD, PAD), 8, 0)]
    assert found[-1] == ((PAD, PAD, PAD, PAD), 9, 3)
    around = [PAD, PAD, *long, PAD, PAD]
    assert found[2:-1] == [((around[k], around[k + 1], around[k + 3], around[k + 4]), x, 2) for k, x in enumerate(long)]


def test_held_out_words_are_predicted_better_than_by_their_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learn, rest = docs.where("doc_id % 5 <> 0"), docs.where("doc_id % 5 = 0 AND lang = 'en'")
    scored = score(rest, train(learn)).groupBy().sum("log_likelihood", "n_tokens").first()
    words, counts = WordIds(), np.full(PAD, 0.1)
    for _, t in texts(learn):
        np.add.at(counts, words(t.encode()), 1)
    held = [k for _, t in texts(rest) for k in words(t.encode())]
    assert scored[1] == len(held)
    assert scored[0] / scored[1] > np.log(counts / counts.sum())[held].mean()


def test_odd_rows_are_scored(odd, none):
    rows = pseudo_likelihood(odd).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in rows) == Counter((i, len((t or "").split())) for i, t in texts(odd))
    assert all((r.mean_log_probability is None) == (r.n_tokens == 0) and r.log_likelihood <= 0 for r in rows)
    assert pseudo_likelihood(none).count() == 0


@pytest.mark.parametrize("most", [1 << 18, 40, 0])
def test_words_of_one_id_are_told_apart(spark, documents, most):
    rare = next(w for w in (f"junk{k}" for k in range(100_000)) if zlib.crc32(w.encode()) % PAD == zlib.crc32(b"the") % PAD)
    weights, words = fitted(documents)
    counts = Counter(w for _, t in texts(documents) for w in (t or "").encode().lower().split())
    assert Counter(r.n for r in words.collect()) == Counter(counts.values())
    ids = Counter()
    for w, n in counts.items():
        ids[zlib.crc32(w) % PAD] += n
    asked = [(1, "see the end"), (2, f"see {rare} end"), (3, None)] + [(10 + i, t) for i, t in texts(documents)[:20]]
    docs = spark.createDataFrame(asked, "doc_id bigint, text string")
    plain = {r.doc_id: r.log_likelihood for r in score(docs, weights).collect()}
    found = {r.doc_id: r.log_likelihood for r in score(docs, weights, words, most).collect()}
    for i, t in asked:
        part = sum(np.log(max(counts[w], 1) / (ids[zlib.crc32(w) % PAD] + 1)) for w in (t or "").encode().lower().split())
        assert found[i] == pytest.approx(plain[i] + part, abs=1e-3)
    assert plain[1] == pytest.approx(plain[2], abs=1e-4) and found[1] > found[2] + 3
