import random

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tessera.llm import leakage as k
from tessera.llm.words import reading_words


@given(st.lists(st.integers(0, 30), min_size=1, max_size=80), st.integers(1, 9))
def test_every_window_keeps_its_minimum(values, window):
    grams = np.array(values, np.uint64)
    kept = set(k.winnow(grams, window).tolist())
    for a in range(max(1, len(values) - window + 1)):
        part = values[a : a + window]
        assert any(p in kept and values[p] == min(part) for p in range(a, min(a + window, len(values))))


def brute(docs, items, span=10):
    grams = {}
    for i, t in items:
        w = reading_words(t or "")
        for a in range(len(w) - span + 1):
            grams.setdefault(tuple(w[a : a + span]), set()).add(i)
    out = set()
    for d, t in docs:
        if d is None or t is None:
            continue
        w = reading_words(t)
        for a in range(len(w) - span + 1):
            owners = grams.get(tuple(w[a : a + span]), set())
            if len(owners) == 1:
                out.add((d, next(iter(owners))))
    return out


def tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, excerpt string")


def test_leaks_match_brute_force(spark):
    rnd = random.Random(3)
    words = [f"term{n}" for n in range(300)]
    shared = " ".join(rnd.choice(words) for _ in range(14))
    items = [(i, shared + " " + " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60)))) for i in range(12)] + [(90, None), (91, ""), (92, "few words")]
    docs = [(1000, None), (1001, ""), (None, "x " * 30), (1002, shared)]
    for d in range(120):
        w = [rnd.choice(words) for _ in range(rnd.randint(5, 120))]
        if d % 2:
            source = reading_words(items[rnd.randrange(12)][1])
            a = rnd.randrange(max(1, len(source) - 5))
            piece = source[a : a + rnd.randint(6, 25)]
            at = rnd.randrange(len(w))
            w[at:at] = piece
        docs.append((d, " ".join(w)))
    docs.append((0, docs[4][1]))
    left, right = tables(spark, docs, items)
    got = [(r.doc_id, r.item_id) for r in k.find_leaks(left.withColumn("item_id", left.doc_id), right).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items) and got


def test_typesetting_does_not_hide_a_leak(spark):
    item = "The quick offi cial fox jumps over twelve lazy configured dogs again today"
    item = item.replace("offi cial", "official")
    forms = [
        item.upper(),
        item.replace(" ", "\n> "),
        item.replace("official", "of-\nficial").replace("configured", "con\xadfigured"),
        item.replace("official", "oﬃcial"),
        "* " + item.replace("lazy", "**lazy** [3]").replace("dogs", "<b>dogs</b>"),
        item.replace(" ", ", "),
    ]
    left, right = tables(spark, list(enumerate(forms)) + [(99, item.replace("jumps", "leaps"))], [(1, item)])
    got = {r.doc_id: r for r in k.find_leaks(left, right).collect()}
    assert set(got) == set(range(len(forms))) and got[0].longest_run == 12 and got[0].first_word == 0


def test_rarer_typesetting_does_not_hide_a_leak(spark):
    item = "Der große configured official fox jumps over twelve lazy dogs again today"
    forms = [
        item.upper(),
        item.replace("configured", "con\xad\nfigured").replace("official", "of\xad\r\n> ficial"),
        item.replace("configured", "con-\n# figured").replace("official", "of-\n  // ficial"),
        item.replace("configured", "con<wbr>figured").replace("official", "<font color=red>of</font>ficial"),
        item.replace("lazy", '[lazy](https://a.example/b "Some title")'),
        item.replace("official", "of\u200eficial").replace("dogs", "\u202adogs\u202c"),
    ]
    left, right = tables(spark, list(enumerate(forms)), [(1, item)])
    got = {r.doc_id: r.longest_run for r in k.find_leaks(left, right).collect()}
    assert got == dict.fromkeys(range(len(forms)), 12)


def test_an_item_issued_again_is_reported_for_both(spark):
    passage = " ".join(f"w{n}" for n in range(20))
    items = [(1, passage), (2, passage.upper() + "!"), (3, "other " * 3 + " ".join(f"v{n}" for n in range(15)) + " " + " ".join(f"w{n}" for n in range(12))), (2, passage)]
    left, right = tables(spark, [(7, "intro " + " ".join(f"w{n}" for n in range(4, 20)) + " end"), (8, " ".join(f"w{n}" for n in range(12)))], items)
    got = {(r.doc_id, r.item_id): (r.shared_grams, r.longest_run, r.first_word) for r in k.find_leaks(left, right).collect()}
    # words 2 to 11 and before are also in item 3: from the fifth on they are the passage's own
    assert got == {(7, 1): (7, 16, 1), (7, 2): (7, 16, 1)}


def test_rows_that_repeat_an_item_do_not_hide_its_wording(spark):
    passage, other = " ".join(f"w{n}" for n in range(20)), " ".join(f"v{n}" for n in range(15))
    # item 1 revised; item 4 issued again as 5 and then revised; item 6 shares the other wording with item 7
    items = [(1, passage), (1, passage + " and more"), (4, passage.replace("w", "u")), (5, passage.replace("w", "u")), (5, "now " + passage.replace("w", "u")), (6, other), (7, other + " here"), (7, other)]
    docs = [(10, passage), (11, passage + " and more"), (12, passage.replace("w", "u")), (13, other), (14, "x " + other + " here")]
    left, right = tables(spark, docs, items)
    got = [((r.doc_id, r.item_id), (r.shared_grams, r.longest_run, r.first_word)) for r in k.find_leaks(left, right).collect()]
    assert dict(got) == {(10, 1): (11, 20, 0), (11, 1): (13, 22, 0), (12, 4): (11, 20, 0), (12, 5): (11, 20, 0), (13, 6): (6, 15, 0), (13, 7): (6, 15, 0), (14, 6): (6, 15, 1), (14, 7): (7, 16, 1)}
    assert len(got) == len(dict(got))


def test_wording_of_revised_items_matches_brute_force(spark):
    rnd = random.Random(8)
    words = [f"term{n}" for n in range(200)]
    texts = [[rnd.choice(words) for _ in range(30)] for _ in range(10)]
    items = [(i, " ".join(t)) for i, t in enumerate(texts)]
    items += [(i, " ".join(t[: rnd.randint(12, 28)] + [rnd.choice(words) for _ in range(6)])) for i, t in enumerate(texts[:6])]
    items += [(20, " ".join(texts[3][5:] + ["shared"])), (21, " ".join(texts[8][:25] + ["shared"]))]
    docs = []
    for d in range(100):
        t = rnd.choice(texts)
        a = rnd.randrange(20)
        docs.append((d, " ".join([rnd.choice(words) for _ in range(9)] + t[a : a + rnd.randint(8, 20)] + ["end"])))
    left, right = tables(spark, docs, items)
    got = [(r.doc_id, r.item_id) for r in k.find_leaks(left, right).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, items) and got


def test_extension_from_the_hit():
    doc, item = np.arange(40, dtype=np.uint64), np.arange(10, 30, dtype=np.uint64)
    item = item.copy()
    item[3] = 999
    assert k.extend(doc, item, np.ones(20, bool), [10], 10) == (7, 16, 14)
    assert k.extend(doc, item, np.zeros(20, bool), [10], 10) is None and k.extend(doc, item, np.ones(20, bool), [-30, 35], 10) is None


def test_half_of_the_documents_hold_one_passage(spark):
    passage = " ".join(f"w{n}" for n in range(30))
    docs = [(n, f"d{n} " + (passage if n % 2 else "nothing to see here at all")) for n in range(2000)]
    left, right = tables(spark, docs, [(1, passage)])
    got = k.find_leaks(left, right).collect()
    assert len(got) == 1000 and all(r.longest_run == 30 and r.first_word == 1 for r in got)


def test_empty_sides_and_long_texts(spark):
    left, right = tables(spark, [(1, "a b c d e f g h i j " * 20_000)], [(1, "q a b c d e f g h i j")])
    assert k.find_leaks(left, right).count() == 1
    assert k.find_leaks(left.limit(0), right).count() == 0 and k.find_leaks(left, right.limit(0)).count() == 0


def test_excerpts(spark):
    df = spark.createDataFrame([(1, "Do this.\n\nExcerpt: a b.\nc\n\nQuestion: what?"), (2, "no frame"), (3, None)], "item_id int, text string")
    assert [r.excerpt for r in k.excerpts(df).orderBy("item_id").collect()] == ["a b.\nc", "no frame", None]
