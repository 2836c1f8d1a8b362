"""Tokenizing, leaks and sentences."""

import random

import numpy as np
import pytest
from conftest import SMALL, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from codeweft.llm import leakage, queries, sentences, tokenize

FEW = settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))


def docs(spark, *texts, columns="doc_id long, text string"):
    return spark.createDataFrame(list(enumerate(texts)), columns)


TEXTS = ["", None, "Hello <|endoftext|> world", "naïve café 🚀👩‍👩‍👧 中文字符", "a\r\n\t b  ", "\x00\x7f", "x" * 20_000, "日本語" * 500]


def test_round_trip(spark):
    enc = tokenize.encode(docs(spark, *TEXTS))
    ids = {r.doc_id: r.ids for r in enc.collect()}
    assert ids[0] == [] and ids[1] == [] and 50256 not in ids[2]
    assert {r.doc_id: r.text for r in tokenize.decode(enc).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert tokenize.encode(docs(spark, *TEXTS).limit(0)).count() == 0


def test_same_ids_as_the_other_library(spark):
    import base64

    import tiktoken
    from public_tokenizers import PATTERN

    with open("/opt/tokenizers/byte_bpe_50k.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.ids for r in tokenize.encode(docs(spark, *TEXTS)).collect()}
    assert got == {i: other.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


def test_offsets(spark):
    for r in tokenize.encode(docs(spark, *TEXTS), offsets=True).collect():
        text = TEXTS[r.doc_id] or ""
        assert len(r.ids) == len(r.starts) == len(r.ends)
        assert not text or (r.starts[0] == 0 and r.ends[-1] == len(text))
        assert all(a < b for a, b in zip(r.starts, r.ends)) and all(b >= a for a, b in zip(r.starts[1:], r.ends))


def test_decoding_of_a_cut_list(spark):
    ids = tokenize.encode(docs(spark, "🚀")).first().ids
    assert len(ids) > 1
    cut = spark.createDataFrame([(1, ids[:1]), (2, None), (3, [10**6])], "doc_id long, ids array<int>")
    assert [r.text for r in tokenize.decode(cut).orderBy("doc_id").collect()] == ["�", "", "�"]


# --- leaks

RND = random.Random(7)
VOCAB = [f"w{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
ITEM = [RND.choice(VOCAB) for _ in range(60)]
HAN = "".join(chr(0x4E00 + RND.randrange(3000)) for _ in range(80))


def noise(n, seed):
    r = random.Random(seed)
    return [r.choice(VOCAB) for _ in range(n)]


def changed(words, every):
    return [w if (i + 1) % every else "zzz" for i, w in enumerate(words)]


def test_leaks(spark):
    part = ITEM[20:36]
    yes = [
        part[:15], changed(part[:15], 7), [w.upper() for w in part], [f"**{w}**" for w in part], [f"{w}&nbsp;" for w in part], [w[:2] + "­" + w[2:] for w in part],
        ["".join(chr(ord(c) + 0xFEE0) for c in w) for w in part], [f"<b>{w}</b>," for w in part], ["\n> " + w for w in part], noise(9000, 1) + part + noise(9000, 2), ITEM,
    ]
    no = [part[:14], changed(part[:15], 4), part[:8] + ["x"] + part[8:], part[::-1], [], noise(200, 3)]
    texts = [" ".join(noise(30, 10 + i) + w + noise(30, 90 + i)) for i, w in enumerate(yes + no)]
    texts += ["前" + HAN[10:41] + "后", "，".join(HAN[10:40]), HAN[10:39], None, "", "1. " + " ".join(part[:8]) + "\n2. " + " ".join(part[8:])]
    items = spark.createDataFrame([(5, " ".join(ITEM)), (6, HAN), (7, "too short"), (8, None)], "item_id int, text string")
    got = rows(leakage.leaks(docs(spark, *texts), items))
    n = len(yes) + len(no)
    assert got == sorted([(i, 5) for i in range(len(yes))] + [(n, 6), (n + 1, 6), (n + 5, 5)], key=repr)
    assert leakage.leaks(docs(spark, *texts), items.limit(0)).count() == 0
    assert leakage.leaks(docs(spark, *texts).limit(0), items).count() == 0


def test_leaks_with_markup_inside(spark):
    inside = [
        "[{}](https://a.b/c_(d)?e=f)", '[{}](<https://a.b/c> "a title")', "![{}](x/y.png)", "{} ![a diagram](data:image/png;base64,AA+B/C==)", "{} <!-- a > b\n\nc -->", "[{}][ref one]", "{}[^12]", "[[Some page|{}]]",
        '{} <img alt="a > b" src="data:image/png;base64,' + "AAAA+BB/" * 60 + '">', '<span\n  class="x y"\n  id=z>{}</span>', "<https://a.b/c> {}", "[url=https://a.b/c]{}[/url]", "\\textbf{{{}}}", "<style>p {{ x: y }}</style>{}",
    ]
    part = ITEM[20:40]
    texts = [" ".join(noise(30, n) + part[:9] + [m.format(part[9])] + part[10:] + noise(30, 50 + n)) for n, m in enumerate(inside)]
    texts += ["<!-- " + " ".join(part) + " -->", '<img src="x" alt="' + " ".join(part) + '">', "a <b and " + " ".join(part) + " c> d"]
    items = spark.createDataFrame([(5, " ".join(ITEM)), (6, HAN)], "item_id int, text string")
    zh = HAN[10:25] + "[" + HAN[25] + "](https://a.b/c)" + HAN[26:41]
    n = len(texts)
    assert rows(leakage.leaks(docs(spark, *texts, zh), items)) == sorted([(i, 5) for i in range(n)] + [(n, 6)], key=repr)


def test_leaks_of_many_items_in_salted_pieces(spark, monkeypatch):
    rnd = random.Random(3)
    items = [" ".join(f"{rnd.getrandbits(30):x}" for _ in range(18)) for _ in range(50_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, h int").repartition(4)
    asked = [0, 7, 7, 49_999]
    texts = [" ".join(noise(40, i)) + " " + items[k] for i, k in enumerate(asked)] + [" ".join(noise(80, 99))]
    assert rows(leakage.leaks(docs(spark, *texts), df)) == [(i, k) for i, k in enumerate(asked)]  # over BROADCAST_ROWS sketches
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", 0)
    few = df.where("item_id < 40")
    assert rows(leakage.leaks(docs(spark, *texts, items[3]), few)) == [(0, 0), (1, 7), (2, 7), (5, 3)]


def test_leaks_of_repeated_words_and_items(spark):
    items = spark.createDataFrame([(1, "a " * 40), (1, " ".join(ITEM)), (2, "a " * 40), (2, "a " * 40), (None, "a " * 40)], "item_id int, text string")
    assert rows(leakage.leaks(docs(spark, "a " * 5000, "b " * 50, " ".join(ITEM[:15])).withColumnRenamed("doc_id", "row"), items, "row")) == [(0, 1), (0, 2), (2, 1)]


def test_stretches_longer_than_the_reach(spark):
    """Any stretch that counts has a part within REACH that does."""
    rnd = random.Random(11)
    for _ in range(3000):
        n = rnd.randint(15, 220)
        same = [rnd.random() > 0.15 for _ in range(n)]
        whole, need, reach = leakage._holds(np.arange(n), np.where(same, np.arange(n), -1), 0, 15), 15, leakage.REACH["word"]
        runs = [i for i in range(n - 4) if all(same[i : i + 5])]
        near = any(leakage._holds(np.arange(n)[max(0, i - reach) : i + 5 + reach], np.where(same, np.arange(n), -1)[max(0, i - reach) : i + 5 + reach], 0, need) for i in runs)
        assert whole == near


def brute_leak(item, doc):
    for s in range(-len(item), len(doc)):
        same = [item[j] == doc[j + s] for j in range(max(0, -s), min(len(item), len(doc) - s))]
        for a in range(len(same)):
            for b in range(a + 15, len(same) + 1):
                if same[a] and same[b - 1] and 7 * same[a:b].count(False) <= b - a:
                    return True
    return False


@FEW
@given(st.lists(st.tuples(st.integers(0, 45), st.integers(10, 25), st.integers(3, 30)), min_size=4, max_size=8))
def test_leaks_like_brute_force(spark, cuts):
    made = [noise(12, n) + changed(ITEM[a : a + k], e) + noise(12, 50 + n) for n, (a, k, e) in enumerate(cuts)]
    got = rows(leakage.leaks(docs(spark, *map(" ".join, made)), spark.createDataFrame([(1, " ".join(ITEM))], "item_id long, text string")), "doc_id")
    assert got == [(i,) for i, w in enumerate(made) if brute_leak(ITEM, w)]


# --- sentences

CASES = [
    ["Dr. Ost saw it on Jan. 13 at 3.5 p.m. in e.g. U.S. land.", "It took approx. 25.36 sec. vs. 4 sec. before.", "What?!"],
    ['Mr. Ilk wrote: "Keep it. It has 2 callers."', 'The log said "Done. Gone." and then\nnothing (it was never used. Really.) came.', "fold_digest() is called."],
    ["We waited ... and it fired.", "Run it with depth=3... or accept.", "See www.a.b/c?d=1 now."],
    ["„Wird es noch benutzt?“, fragte das Team.", "Am 3. Mai kam z. B. Nr. 4, d. h. die alte.", "Siehe Abb. 15.", "Wenn ja."],
    ["« Est-ce utile ? » demande M. Ost.", "Oui !"],
    ["—¿Sigue? —preguntó el Sr. Ost.", "¡No!", "¿Qué?"],
    ["日志写着“完成。清空。”然后没有了。", "有人问：“还用吗？”没有回答……真的。", "第三句！"],
    ["「まだですか？」と尋ねました。", "重みは9.9です（図9。）。", "次。"],
    ["См. рис. 9 и табл. 5.", "Это 2024 г. без ошибок и т. д.", "Каждый."],
    ["แต่ละโหนดเก็บ", "งานใช้ 9 วินาที", "ระบบใหม่"],
    ["डॉ. Ost ने कल की।", 'लॉग में "तैयार। खाली।" था।'],
    ["راجع د. Ost أمس.", "لماذا 9.9؟", "لا!"],
    ['로그에는 "완료. 삭제." 라고 적혔습니다.', "처리 9.9초."],
    ["Γιατί 9,9;", "Μην καλείτε, π.χ. στο α.", "Βλ. σελ. 9."],
    ["ስርዓቱ ያነባል።", "ለምን?"],
    ["စနစ် ဖတ်သည်။", "ပြင်ပြီး။"],
    ["Ինչո՞ւ է։", "Տար, օր. ին։"],
]


def split(spark, *texts):
    got = sentences.units(docs(spark, *texts)).orderBy("doc_id", "start_char").collect()
    return [[texts[i][r.start_char : r.end_char] for r in got if r.doc_id == i] for i in range(len(texts))]


def test_sentences_of_many_scripts(spark):
    gap = ["" if i in (6, 7) else "  " if i == 2 else " " for i in range(len(CASES))]
    assert split(spark, *[g.join(c) for g, c in zip(gap, CASES)]) == CASES


def test_layout(spark):
    parts = ["# A. B? C", "One.", "Two\nlines.", "- item. ", "Next", "* other", "```py\nx. Y\n\n# z. A\n```", "1. First.", "Rest", "2. second", "Title. x\n===", "End"]
    text = "# A. B? C\nOne. Two\nlines.\n\n\n- item. Next\n* other\n```py\nx. Y\n\n# z. A\n```\n1. First. Rest\n2. second\n\nTitle. x\n===\r\n\r\nEnd  \n"
    assert split(spark, text) == [[p.strip() for p in parts]]
    assert split(spark, "wartet seit dem\n12. August. Ja", "~~~\nopen. Code") == [["wartet seit dem\n12. August.", "Ja"], ["~~~\nopen. Code"]]


@pytest.mark.parametrize("marks", ["()", "[]", "（）", "【】", "「」", "『』", "《》", "„“", "“”", "«»", "‹›", "‘’", '""', "''", "``"])
def test_quotations_of_any_length(spark, marks):
    inner = marks[0] + " ".join(f"Step {i} is done. It holds." for i in range(60)) + marks[1]
    text = f"The log wrote {inner} and then stopped. It was short. Then came \"Off. On.\" again. End."
    assert split(spark, text) == [[f"The log wrote {inner} and then stopped.", "It was short.", 'Then came "Off. On." again.', "End."]]


def test_many_brackets_inside_one(spark):
    first = "It ran (" + "a (b. C) " * 40 + "d. E) once."
    assert split(spark, f"{first} End.") == [[first, "End."]]


def test_nested_brackets(spark):
    for a, b in ["()", "[]", "（）", "【】", "「」", "『』", "《》", "“”"]:
        first = f"It ran {a}one. Two {a}three. Four {a}five. Six{b} seven. Eight{b} nine. Ten{b} once."
        assert split(spark, f"{first} End.") == [[first, "End."]]


def test_layout_of_any_length(spark):
    long = "This heading goes on. " * 30 + "It ends"
    question = "Γιατί " + "καλεί ο κόμβος τον άλλον " * 20 + "σήμερα;"
    texts = [f"{long}\n=====\nThen. End.", f"{question} Ναι.", "Text:\n" + " " * 70 + "- one. Two\n" + " " * 70 + "- three", "1. One.\n1234. Two. Three\nFour", "  ## In. Out\nText.", "It ran " + "(a. B " * 12 + ") c. D" * 11 + ") once. End."]
    assert split(spark, *texts) == [
        [f"{long}\n=====", "Then.", "End."], [question, "Ναι."], ["Text:", "- one.", "Two", "- three"], ["1. One.", "1234. Two.", "Three", "Four"], ["## In. Out", "Text."], [texts[-1][:-5], "End."],
    ]
    many = "It ran (" + "a (b. C) " * 20_000 + ") once."
    assert split(spark, f"{many} End.") == [[many, "End."]]


def test_no_units_and_awkward_texts(spark):
    df = docs(spark, None, "", " \t \xa0\n", ". B", "🚀 Go. Ö.", "(" * 3000, '"' * 999, "a. " * 3000, "(((a. b). c). d). E")
    got = sentences.units(df.selectExpr("*", "1 as row", "2 as i", "3 as p")).orderBy("doc_id", "start_char").collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    per = {i: [(r.start_char, r.end_char) for r in got if r.doc_id == i] for i in texts}
    assert per[0] == per[1] == per[2] == [] and per[3] == [(0, 3), (4, 5)] and per[4] == [(0, 5), (6, 8)]
    for i, t in texts.items():
        covered = {x for a, b in per[i] for x in range(a, b)}
        assert all(c.isspace() for x, c in enumerate(t or "") if x not in covered)
        assert all(t[a:b] == t[a:b].strip() and a < b for a, b in per[i])
        assert all(b <= c for (_, b), (c, _) in zip(per[i], per[i][1:]))
    assert sentences.units(df.limit(0)).count() == 0
    twice = docs(spark, "A b. C d.").union(docs(spark, "A b. C d."))
    assert rows(sentences.units(twice)) == [(0, 0, 4), (0, 0, 4), (0, 5, 9), (0, 5, 9)]


@FEW
@given(st.lists(st.text(st.sampled_from("ab A.!?\n\"'()「」。 -#1`\r“”ก;"), max_size=60), min_size=12, max_size=12))
def test_units_cover_any_text(spark, texts):
    got = sentences.units(docs(spark, *texts)).orderBy("doc_id", "start_char").collect()
    for i, t in enumerate(texts):
        spans = [(r.start_char, r.end_char) for r in got if r.doc_id == i]
        rest = "".join(t[a:b] for a, b in zip([0, *[e for _, e in spans]], [*[s for s, _ in spans], len(t)]))
        assert not rest.strip() and all(t[a:b] == t[a:b].strip() and a < b for a, b in spans)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0
