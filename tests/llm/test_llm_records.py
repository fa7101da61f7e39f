"""Tool calls, personal data, benchmark leaks and web pages."""

import json

import pytest
from helpers import personal
from pyspark.sql import functions as F

from runledger.llm import disclosure, dom, leakage, page_text, tool_calls

TOOLS = {"add": {"required": ["x", "y"], "properties": {"x": "integer", "y": "number"}}}


def _call(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls]})


def test_calls_are_linked_checked_and_ordered(spark):
    rows = [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", _call(("b", "add", '{"y": 2.50, "x": "${a}"}'), ("a", "add", '{"y":1,"x":2}'), ("z", "nope", "{}"), ("q", "add", "[1]"))),
        (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": 'say "3"'})),
        (1, 3, "tool", json.dumps({"tool_call_id": "a", "content": "again"})),
        (1, 4, "tool", json.dumps({"tool_call_id": "zz", "content": "3"})),
        (1, 5, "tool", None),
        (1, 6, "assistant", "tool_calls {broken"),
        (2, 1, "assistant", _call(("c1", "add", '{"x": "${c2}"}'), ("c2", "add", '{"x": "${c1}"}'), ("c3", "add", '{"x":1,"y":"${c1}"}'), ("c4", "add", '{"x":1,"y":2}'))),
        (None, 1, "assistant", _call(("n", "add", "{}"))),
    ]
    messages = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, place int")
    linked = tool_calls.link_calls(tool_calls.calls_of(messages), tool_calls.results_of(messages), TOOLS)
    got = {r["call_id"]: r for r in linked.collect()}
    assert {k: r["status"] for k, r in got.items()} == {"a": "linked", "b": "unanswered", "z": "unanswered", "q": "unanswered", "zz": "orphan", "c1": "unanswered", "c2": "unanswered", "c3": "unanswered", "c4": "unanswered"}
    assert {k: r["errors"] for k, r in got.items() if k in "abzq"} == {"a": "", "b": "x is not integer but string", "z": "unknown tool", "q": "arguments are not an object"}
    assert got["a"]["n_results"] == 2 and got["a"]["json"] == '{"arguments":{"x":2,"y":1},"id":"a","name":"add","result":"say \\"3\\""}'

    def place(k):
        return got[k]["order_turn"], got[k]["order_place"], got[k]["order_step"]

    assert place("a") < place("b")
    assert {k for k, r in got.items() if r["cyclic"]} == {"c1", "c2", "c3"}
    nothing = tool_calls.link_calls(tool_calls.calls_of(messages.where("turn > 9")), tool_calls.results_of(messages.where("turn > 9")), TOOLS)
    assert nothing.count() == 0


def test_a_chain_behind_a_forward_reference_moves(spark):
    calls = [(1, k, "assistant", _call((f"k{k}", "add", json.dumps({"x": f"${{k{k - 1}}}" if k else "${k9}"})))) for k in (0, 1, 2)]
    calls.append((1, 9, "assistant", _call(("k9", "add", "{}"))))
    messages = spark.createDataFrame(calls, "conv_id long, turn long, role string, text string")
    linked = tool_calls.link_calls(tool_calls.calls_of(messages), tool_calls.results_of(messages), TOOLS)
    order = linked.orderBy("order_turn", "order_place", "order_step").collect()
    assert [r["call_id"] for r in order] == ["k9", "k0", "k1", "k2"] and not any(r["cyclic"] for r in order)


ODD = [
    "a@b.c_d@e.f", "x@y", "1.2.3.4.5", "999.1.1.1 1.1.1.1", "+1 (017) 555-7713", "é é 4111 1111 1111 1111 é", "4111-1111-1111-1111@a.b",
    "a" * 3000 + "@b", "1" * 5000, "+1 ( ( (", "a@b.c." * 3, "@@a@b.c", "+12345678901234567", "0.0.0.0000255", None, "", "🎉 x@y.zz", "1.1.1.256",
    "call +49 30 1234567, or +1.2.3.4.5.6.7.8.9", "1 2 3 4 5 6 7 8 9 0 1 2 8", "a@b.c" * 40, ".".join(["1"] * 400), "a.b" * 3000 + "@" + "c." * 3000,
]


def test_base_spans_are_those_of_the_patterns(spark):
    rows = [*enumerate(ODD), (3, ODD[3]), (None, "x@y.zz")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, spans string")
    got = disclosure.find_personal_data(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = "x@y.zz" if r["doc_id"] is None else ODD[r["doc_id"]]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == personal(text)
    assert disclosure.find_personal_data(df.where("doc_id < 0")).count() == 0


def test_words_that_disclose_are_found_and_replaced(spark):
    rows = [(i, f"note from Zebulon at zeb@quix.org says {i} hi") for i in range(5)] + [(50 + i, "plain note from nobody") for i in range(30)]
    rows += [(90, None), (91, "x@y.zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in disclosure.find_personal_data(df).collect()}
    assert found[0]["n_terms"] >= 1 and "term:10:17" in found[0]["spans"] and "email:21:33" in found[0]["spans"]
    assert found[50]["spans"] == "" and found[91]["n_terms"] == 0
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitise(df).collect()}
    assert "Zebulon" not in clean[0] and "[EMAIL]" in clean[0] and clean[0].startswith("note from")
    assert clean[50] == rows[5][1] and clean[90] is None and clean[91] == "[EMAIL]"


def test_words_that_disclose_go_from_the_whole_text(spark):
    far = "of this and that " * 8
    rows = [(i, f"Kim wrote {far}, {i} to kim@quix.org {far} (zebulon) and Zebulon-Kim's, KIM. {i}") for i in range(5)]
    rows += [(50 + i, f"they wrote to s {far} {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in disclosure.sanitise(df).collect()}
    for i in range(5):
        assert clean[i] == f" wrote {far}, {i} to [EMAIL] {far} () and -'s, . {i}"
    assert all(clean[i] == t for i, t in rows[5:])
    found = {r["doc_id"]: r for r in disclosure.find_personal_data(df).collect()}
    assert found[0]["n_terms"] == 5 and found[0]["n_email"] == 1 and found[50]["spans"] == ""
    assert found[0]["spans"].startswith("term:0:3,email:")


def test_leaked_items_are_found_and_others_not(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(1500)]

    def text(n):
        return " ".join(rng.choice(words, n))

    items = [(k, text(int(rng.integers(10, 50))) + ". The answer is " + text(4) + ".") for k in range(30)]
    docs = [(1000 + k, text(int(rng.integers(5, 400)))) for k in range(150)]
    held = set()
    for k in range(25):
        told = items[k][1].upper().replace(" ", "  ") if k % 3 == 0 else items[k][1]
        docs.append((k, f"{text(30)} {told} {text(50)}"))
        held.add((k, k))
    half = items[29][1].split()
    for k in range(0, 8, 2):
        half[k] = "changed"
    docs += [(500, " ".join(half)), (600, None), (601, ""), (602, "short")]
    held.add((500, 29))
    bench = spark.createDataFrame([*items, (98, None), (99, "")], "item_id long, text string")
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, cosine double")
    found = leakage.find_leaks(df, bench)
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == held
    assert leakage.find_leaks(df.where("doc_id < 0"), bench).count() == 0
    assert leakage.find_leaks(df.limit(5), bench.where("item_id > 500")).count() == 0


def test_an_item_in_a_third_of_all_documents_is_found(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(15000)]

    def text(n):
        return " ".join(rng.choice(words, n))

    items = [(k, text(20) + ". The answer is " + text(4) + ".") for k in range(3)]
    docs = [(k, text(60)) for k in range(300)]
    for k in range(0, 300, 3):
        docs[k] = (k, f"{text(int(rng.integers(0, 40)))} {items[0][1]} {text(30)}")
    docs[1] = (1, f"{text(30)} {items[1][1]} {text(30)}")
    found = leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == {(k, 0) for k in range(0, 300, 3)} | {(1, 1)}


def test_short_items_in_long_documents_are_found(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]

    def text(n):
        return " ".join(rng.choice(words, n))

    items = [(k, text(3 + k % 10)) for k in range(60)]
    docs = [(k, f"{text(int(rng.integers(200, 400)))} {items[k][1]} {text(300)}") for k in range(60)]
    found = leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in found.collect()} >= {(k, k) for k in range(60)}


def test_common_subsequence_against_the_table():
    import random

    rng = random.Random(2)
    for _ in range(50):
        x, y = ([rng.randrange(6) for _ in range(rng.randint(0, 30))] for _ in range(2))
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, a in enumerate(x):
            for j, b in enumerate(y):
                table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
        assert leakage.common_subsequence(x, y) == table[-1][-1]


PARAGRAPH = "The quick brown fox jumps over the lazy dog, again and again, until the evening comes. It was a long day for everyone."


def _pages(n=40):
    return [
        (k, f"u{k}", f"<html><head><title>T</title><script>a='<p>x</p>'</script></head><body><nav><ul><li><a href=/>Home</a><li><a>News</a></ul></nav>"
         f"<div class=ad>Buy now {k}</div><article><h1>Head {k}</h1><p>{PARAGRAPH} {k}<br>more&amp;<p><b>{PARAGRAPH}</article><footer>&copy; us</footer>")
        for k in range(n)
    ]


def test_main_text_of_pages(spark):
    df = spark.createDataFrame([(*p, "t") for p in [*_pages(), (90, None, None), (91, "v", "")]], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in page_text.extract(df).collect()}
    assert len(got) == 42
    for k in range(40):
        assert got[k]["text"] == f"Head {k}\n\n{PARAGRAPH} {k} more&\n\n{PARAGRAPH}" and got[k]["n_chars"] == len(got[k]["text"])
    assert got[90]["text"] == got[91]["text"] == "" and got[90]["n_chars"] == 0
    assert page_text.extract(df.where("page_id < 0")).count() == 0


def test_pages_without_telling_tags(spark):
    seen = spark.createDataFrame(_pages(), "id long, url string, html string").select("id", "html")
    trees = page_text.fit(seen)
    html = (
        "<body><header><div>Site</div><nav><a href=x>Home</a></nav></header><div id=content><h1>Headline</h1>" + f"<p>{PARAGRAPH}</p>" * 5 + "</div>"
        "<div class=comments><h3>Comments</h3><div class=comment><p>I do not agree with this story at all, really.</p></div></div>"
        "<form class=newsletter><p>Subscribe today</p><input></form><footer>Copyright</footer>"
    )
    page = dom.Page(html)
    assert page_text.main_text(page, trees.chance(page.features())) == "\n\n".join(["Headline", *[PARAGRAPH] * 5])


@pytest.mark.parametrize("html", ["just text", "<p>only", "<" * 200, "<div " * 30 + ">x", "<td>a<td>b", "</p></div>x", "<!-- open", "<script>x", "<a href='", "&#0;&bogus;"])
def test_broken_html_is_read(html):
    page = dom.Page(html)
    assert page.features().shape == (len(page.nodes), dom.FEATURES)


@pytest.mark.parametrize(
    ("html", "blocks"),
    [
        ("<head><meta charset=u><title>t</title><body><article><p>text</article>", ["text"]),
        ("<head><title>t</title><p>one<p>two", ["one", "two"]),
        ("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b</p>", ["a x=1 b"]),
        ("<div><noscript><img></div><p>after</p><noscript>n</noscript>", ["after"]),
        ("<p>a</p><noscript><img><p>b</p>", ["a", "b"]),
        ("<p>a</p><svg><path><p>b</p>", ["a", "b"]),
        ("<div>a<button>x<button>y</button> b</div><p>c", ["a b", "c"]),
        ("<template><div><p>x</div></template><p>y", ["y"]),
    ],
)
def test_unclosed_elements_do_not_take_the_page(html, blocks):
    assert [text for _, text in dom.Page(html).blocks] == blocks


def test_decoding_is_the_best_consistent_choice():
    import itertools

    import numpy as np

    rng = np.random.default_rng(4)
    for _ in range(20):
        parent = np.array([-1, *(int(rng.integers(0, k)) for k in range(1, 8))])
        chance = rng.random(8)
        kept = dom.best_choice(parent, chance)
        best = max(
            (sum(np.log(c if k else 1 - c) for c, k in zip(chance, pick, strict=True)), pick)
            for pick in itertools.product([False, True], repeat=8)
            if all(not k or p < 0 or pick[p] for k, p in zip(pick, parent, strict=True))
        )
        assert tuple(kept) == best[1]


@pytest.mark.parametrize(
    ("html", "blocks"),
    [
        ("<p class=it's>two</p>", ["two"]),
        ("<p title='a>b' data-x=\"c'd>\">one</p>two", ["one", "two"]),
        ('<p class="open>one</p><p>two', ["one", "two"]),
        ("<p a=1/>x<p/>y", ["x", "y"]),
        ("<p =x>one</p>", ["one"]),
        ("a < b <p>c", ["a < b", "c"]),
        ("<map><p>shown</p></map>", ["shown"]),
        ("<div><object><p>instead</p></object></div>", ["instead"]),
    ],
)
def test_tags_are_read_as_browsers_do(html, blocks):
    assert [text for _, text in dom.Page(html).blocks] == blocks


def test_time_follows_the_length_of_a_page():
    import time

    odd = ["<a '" * 40_000, "<div>" * 40_000 + "</section>" * 40_000, "<ul><li><ul>" + "<div>" * 20_000 + "<li></li>" * 20_000, '<p class="x>' * 40_001]
    odd += ["<p title='" * 40_000 + ">", "<script>" * 40_000, "<svg>" * 20_000 + "<div>" * 20_000 + "</p>" * 20_000, "<!--" * 40_000]
    for html in odd:
        begin = time.perf_counter()
        dom.Page(html)
        assert time.perf_counter() - begin < 5, html[:20]


@pytest.mark.parametrize("key", [7, None])
def test_pages_of_one_id_are_learned_from(spark, key):
    """Pages teach by what they hold: one id for all, or none, leaves the result as it is."""
    pages = _pages(450)
    frame = lambda f: spark.createDataFrame([(f(k), u, h) for k, u, h in pages], "page_id long, url string, html string")
    trees = page_text.fit(frame(lambda k: key).select(F.col("page_id").alias("id"), "html"))
    assert len(trees.feature) == page_text.ROUNDS
    assert {r["url"]: r["text"] for r in page_text.extract(frame(lambda k: key)).collect()} == {r["url"]: r["text"] for r in page_text.extract(frame(lambda k: k)).collect()}


def test_leaks_against_every_place(spark):
    """All that the subsequence and answer rule finds when every place of every document is looked at."""
    import random
    import re

    rng = random.Random(11)
    vocabulary = ["the", "of", "and", "in"] * 12 + [f"w{k}" for k in range(260)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {k: (text(rng.randrange(8, 40)), text(rng.randrange(1, 4))) for k in range(14)}
    told = [(k, " ".join(body) + ". " + " ".join(answer)) for k, (body, answer) in items.items()]
    rows = []
    for i in range(90):
        words = text(rng.randrange(0, 160))
        if i % 2:
            body, answer = items[rng.randrange(14)]
            whole = body + answer
            kind = rng.randrange(5)
            if kind == 1:  # thinned
                whole = [w for w in whole if rng.random() > 0.15]
            elif kind == 2:  # reworded, the answer kept
                whole = [w if rng.random() > 0.35 else rng.choice(vocabulary) for w in body] + answer
            elif kind == 3:  # filled
                whole = [x for w in whole for x in ([w] if rng.random() > 0.3 else [w, rng.choice(vocabulary)])]
            elif kind == 4:  # half of it, mixed
                whole = rng.sample(whole, len(whole) // 2)
            cut = rng.randrange(len(words) + 1)
            words = words[:cut] + whole + words[cut:]
        rows.append((i, " ".join(words)))
    got = {
        (r["doc_id"], r["item_id"])
        for r in leakage.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(told, "item_id long, text string")).collect()
    }
    words_of = lambda t: re.findall(r"\w+", t.lower())
    want = set()
    for i, t in rows:
        held = words_of(t)
        for k, item in told:
            own = words_of(item)
            reach = len(own) + max(1, len(own) // 2)
            answer = items[k][1]
            places = [a for a in range(len(held) - len(answer) + 1) if held[a : a + len(answer)] == answer]
            for a in range(max(1, len(held) - reach + 1)):
                common = leakage.common_subsequence(own, held[a : a + reach])
                near = any(a - len(own) <= p <= a + reach + len(own) for p in places)
                if common >= leakage.COVERED * len(own) or (near and common >= leakage.PARTLY * len(own)):
                    want.add((i, k))
                    break
    assert len(want) > 30 and len(got & want) >= 0.99 * len(want)
    assert not got - want


def test_every_document_shapes_the_latent_space(spark):
    """Also with more documents than a sample of 6,000 would hold."""
    import numpy as np

    from runledger.llm.common import Scratch

    docs = spark.createDataFrame([(k, f"word{k} of{k} text{k} twice twice") for k in range(7000)], "id long, text string")
    items = spark.createDataFrame([(1, "an item of five words")], "item long, text string")
    space = leakage.fit(docs, items, Scratch(spark, "space"))
    held = np.flatnonzero(space.frequency)
    assert len(held) > 10_000 and space.frequency.max() >= 7000
    assert np.linalg.norm(space.basis[held], axis=1).min() > 0.5


def test_products_with_the_matrix_of_passages(spark):
    import random
    import re

    import numpy as np
    import pyarrow as pa

    rng = random.Random(5)
    texts = ["", "  ", *(" ".join(rng.choice(["the", "a", f"w{rng.randrange(300)}"]) for _ in range(rng.choice([1, 15, 16, 17, 400]))) for _ in range(60))]
    passages = leakage._passages(spark.createDataFrame([(t,) for t in texts], "text string"))
    rows = []
    for t in texts:
        words = re.findall(r"\w+", t)
        rows += [words[k : k + leakage.BLOCK] for k in range(0, len(words), leakage.BLOCK)]
    matrix = np.zeros((len(rows), leakage.TERMS))
    for k, words in enumerate(rows):
        np.add.at(matrix[k], leakage._terms(leakage._words(pa.array([" ".join(words)]))[0]), 1)
    frequency, number = leakage._frequencies(passages)
    assert number == len(rows) and (frequency == (matrix > 0).sum(axis=0)).all()
    idf = np.linspace(1, 2, leakage.TERMS)
    right = np.random.default_rng(2).standard_normal((leakage.TERMS, 7))
    part = (matrix * idf) @ right
    want = (matrix * idf).T @ part
    assert np.allclose(leakage._gram_times(passages, idf, right), want, atol=1e-4 * abs(want).max())
    assert np.allclose(leakage._gram(passages, idf, right), part.T @ part, rtol=1e-4)


def test_pipeline_looks_for_leaks_with_all_its_documents(spark, folder, monkeypatch):
    import corpus_pipeline
    import numpy as np

    item = "which of these nine words are held by one document"
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.createDataFrame([(k, f"word{k} of{k} text{k} twice twice") for k in range(7000)] + [(7000, f"so {item} alone")], "doc_id long, text string")
    spaces = []
    monkeypatch.setattr(leakage, "fit", lambda *a, f=leakage.fit: spaces.append(f(*a)) or spaces[-1])
    kept = corpus_pipeline.decontaminate(spark, docs, folder)
    assert {r[0] for r in kept.select("doc_id").collect()} == set(range(7000))
    held = np.flatnonzero(spaces[0].frequency)
    assert len(held) > 10_000 and np.linalg.norm(spaces[0].basis[held], axis=1).min() > 0.5
