import random

import pytest

from tessera.llm import encoding as e

TEXTS = {
    "de": "Die Größe überträgt der Schlüssel außerhalb der Sperre und löscht die Änderung möglichst früh",
    "fr": "La procédure libère la clé étrangère dès le démarrage et protège la mémoire déjà créée",
    "pl": "Część usuwa żądanie później i łączy źródło według reguły zależność dołącza gałąź",
    "ru": "Сервер отправляет поток данных после сбоя и модуль пропускает очередь сообщений постепенно",
    "ja": "必ず検索語の処理は変数を削除するが、順番に文書を結合する。背後で型の鍵は接続を待つ。",
}


def garble(text, chain):
    for true, wrong in e.CHAINS[chain]:
        raw = text.encode(true)
        table = {v: k for k, v in e._TABLES[wrong].items()} if wrong in e._TABLES and e._TABLES[wrong] else None
        text = "".join(table[bytes([b])] for b in raw) if table else raw.decode(wrong)
    return text


@pytest.mark.parametrize("lang, chain", [("de", "utf-8>cp1252"), ("fr", "utf-8>latin-1"), ("fr", "utf-8>cp1252 twice"), ("ru", "utf-8>cp1251"), ("ru", "cp1251>cp1252"), ("ru", "koi8-r>cp1251"), ("pl", "cp1250>cp1252"), ("pl", "utf-8>mac-roman"), ("ja", "cp932>latin-1"), ("ja", "euc_jp>cp1252"), ("de", "utf-8>cp437")])
def test_undo_is_the_inverse(lang, chain):
    assert e.undo(garble(TEXTS[lang], chain), chain) == TEXTS[lang]


@pytest.mark.parametrize("chain", list(e.CHAINS))
def test_clean_ascii_is_never_undone(chain):
    assert e.undo("plain ascii text", chain) is None


def corpus():
    rnd = random.Random(6)
    rows = []
    for n in range(400):
        lang = rnd.choice(list(TEXTS))
        words = TEXTS[lang].split(" ") if lang != "ja" else [x + "。" for x in TEXTS[lang].split("。") if x]
        rows.append([("page", str(n), lang, " ".join(rnd.choice(words) for _ in range(rnd.randint(15, 40)))), lang])
    damaged = {}
    for n, chain in ((3, "utf-8>cp1252"), (17, "utf-8>latin-1"), (30, "utf-8>cp1251"), (44, "utf-8>mac-roman"), (58, "utf-8>cp1252 twice"), (71, "utf-8>cp437")):
        kind, key, group, text = rows[n][0]
        rows[n][0] = (kind, key, group, garble(text, chain))
        damaged[key] = (chain, text)
    rows = [r for r, _ in rows]
    kind, key, group, text = rows[90]
    rows[90] = (kind, key, group, text[:20] + "�" + text[21:])
    damaged[key] = (e.LOST, None)
    quote = ("page", "quote", "de", "If “café” shows up as `cafÃ©` or `�`, the reader picked the wrong table. " + TEXTS["de"])
    return rows + [quote, ("page", "null", "de", None), ("page", "empty", None, ""), ("page", "ascii", None, "plain words")], damaged


def test_finds_and_repairs(spark):
    rows, damaged = corpus()
    df = spark.createDataFrame(rows + [rows[3]], "kind string, key string, group string, text string")
    found = e.find_damage(df)
    got = {r.key: r for r in found.damaged.collect()}
    assert set(got) == set(damaged)
    fixed = {r.key: r.repaired for r in e.repaired(df, found).collect()}
    for key, (chain, text) in damaged.items():
        assert fixed[key] == text, (key, chain, got[key].chain)


def test_one_damaged_stretch(spark):
    rows, _ = corpus()
    clean = TEXTS["de"]
    mixed = clean + " " + garble(TEXTS["de"][:40], "utf-8>cp1252") + " " + clean
    df = spark.createDataFrame(rows + [("page", "mixed", "de", mixed)], "kind string, key string, group string, text string")
    found = e.find_damage(df)
    assert "mixed" in {r.key for r in found.damaged.collect()}
    fixed = {r.key: r.repaired for r in e.repaired(df, found).collect()}
    assert fixed["mixed"] == clean + " " + TEXTS["de"][:40] + " " + clean


@pytest.mark.parametrize("chain", ["utf-8>cp1252", "utf-8>latin-1", "utf-8>koi8-r", "utf-8>mac-roman", "utf-8>cp1252 twice", "cp932>latin-1", "euc_jp>cp1252"])
@pytest.mark.parametrize("head", ["", "背後で"])
def test_stretch_inside_a_sentence_without_blanks(chain, head):
    clean, tail = TEXTS["ja"][:17], TEXTS["ja"][18:]
    garbled = garble(clean, chain)
    assert e.repair_text(f"# {head}{garbled}{tail}", chain) == f"# {head}{clean}{tail}"
    assert (chain, head + clean + tail) in e.possible(head + garbled + tail, e.CHAINS)


def test_stretch_in_a_multi_byte_page():
    stretch = next(g for n in range(2, 17) if len(clean := TEXTS["ja"][:n]) > 2 and (g := clean.encode().decode("gbk", "replace")) and "�" not in g)
    clean = stretch.encode("gbk").decode()
    assert e.repair_text(stretch + TEXTS["ja"][18:], "utf-8>gbk") == clean + TEXTS["ja"][18:]


@pytest.mark.parametrize("text, chain", [("всё тёплый Лёд", "utf-8>koi8-r"), ("Тёплый Лёд", "utf-8>cp1251"), ("«école»", "utf-8>mac-roman"), (TEXTS["ja"], "utf-8>gbk"), (TEXTS["ja"], "utf-8>cp932")])
def test_chance_sequences_in_clean_text_stay(text, chain):
    assert e.repair_text(text, chain) is None


def test_lone_pair_and_lost_characters():
    assert e.repair_text("see Â§2.7… now", "utf-8>cp1252") == "see §2.7… now"
    lost = "検索入門�" + garble(TEXTS["ja"][:9], "utf-8>cp1252") + "版�"
    assert e.repair_text(lost, "utf-8>cp1252") is None and not list(e.possible(lost, e.CHAINS))


def test_finds_a_stretch_inside_a_japanese_sentence(spark):
    rows, _ = corpus()
    inside = garble("必ず検索語の処理は変数を削除するが、順番に文書を結合する。", "utf-8>cp1252") + "背後で型の鍵は接続を待つ。"
    df = spark.createDataFrame(rows + [("page", "inside", "ja", TEXTS["ja"] + inside + TEXTS["ja"])], "kind string, key string, group string, text string")
    found = e.find_damage(df)
    assert {r.key: r.chain for r in found.damaged.collect()}["inside"] == "utf-8>cp1252"
    assert {r.key: r.repaired for r in e.repaired(df, found).collect()}["inside"] == TEXTS["ja"] * 3


def test_empty(spark):
    df = spark.createDataFrame([], "kind string, key string, group string, text string")
    found = e.find_damage(df)
    assert found.damaged.count() == 0 and e.repaired(df, found).count() == 0
    plain = spark.createDataFrame([("p", "1", None, "only ascii"), ("p", "2", None, None)], "kind string, key string, group string, text string")
    assert e.find_damage(plain).damaged.count() == 0


def test_share_of_planted_damage_that_is_restored(spark, sf):
    """Clean pages of the tables, damaged whole or in one stretch in many ways: nearly all are found and restored to the letter."""
    rnd = random.Random(11)
    pages = [(str(r.page_id), r.parsed_book_id, r.text) for r in spark.read.parquet(f"{sf}/page_contents.parquet").where("octet_length(text) > length(text)").orderBy("page_id").collect()]
    known = {r.key for r in e.find_damage(spark.createDataFrame([("page", k, g, t) for k, g, t in pages], "kind string, key string, group string, text string")).damaged.collect()}
    pages = [p for p in pages if p[0] not in known]
    names = ["utf-8>cp1252", "utf-8>latin-1", "utf-8>cp1252 twice", "utf-8>mac-roman", "utf-8>cp437", "utf-8>cp850", "utf-8>cp1251", "cp1250>cp1252", "cp1251>cp1252", "cp932>cp1252"]
    rows, planted = [], {}
    for n, (key, group, text) in enumerate(pages):
        if n % 4 == 0:
            words = text.split(" ")
            a = rnd.randrange(len(words)) if n % 8 else 0
            z = min(len(words), a + rnd.randint(6, 30)) if n % 8 else len(words)
            stretch = " ".join(words[a:z])
            ways = [c for c in names if not stretch.isascii()]
            rnd.shuffle(ways)
            for chain in ways:
                try:
                    garbled = garble(stretch, chain)
                except (UnicodeError, KeyError):
                    continue
                if garbled != stretch:
                    rows.append(("page", key, group, " ".join([*words[:a], garbled, *words[z:]])))
                    planted[key] = text
                    break
            else:
                rows.append(("page", key, group, text))
        else:
            rows.append(("page", key, group, text))
    df = spark.createDataFrame(rows, "kind string, key string, group string, text string")
    found = e.find_damage(df)
    fixed = {r.key: r.repaired for r in e.repaired(df, found).collect()}
    restored = sum(fixed.get(k) == t for k, t in planted.items())
    print(f"planted {len(planted)}, found {len(set(planted) & set(fixed))}, wrongly {len(set(fixed) - set(planted))}, restored {restored}")
    assert len(planted) > 20 and len(set(planted) & set(fixed)) >= 0.95 * len(planted) and not set(fixed) - set(planted)
    assert restored >= 0.85 * len(planted)
