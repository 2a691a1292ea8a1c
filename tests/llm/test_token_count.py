import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from corpuslens.llm import token_count as tc

PATH = public_tokenizers.path("byte_bpe_50k.json")
COUNTS = tc.Counts(PATH, tc.whole_tokens(PATH))


def by_library(text: str) -> int:
    return len(tc.encoder(PATH).encode(text, add_special_tokens=False).ids)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t\r\xa0'stredvmlEé1²½ª")), max_size=60))
def test_counts_equal_the_library(text):
    assert COUNTS.count(text) == by_library(text)


def test_long_special_and_odd_texts():
    for text in ("", " ", "a" * 30_000, "<|endoftext|>", "a <|endoftext|> b", "x\x0by\x85z\x1c", "it's we'll  I'D", "\xa0\xa0a \xa0 b", "日本語 テキスト"):
        assert COUNTS.count(text) == by_library(text)
    text = "the cat's  12 mats!\n" * (tc.LONG_TEXT // 19)
    assert len(text) > tc.LONG_TEXT
    assert COUNTS.count(text) == by_library(text)


def test_texts_of_any_script_are_looked_up(monkeypatch):
    """No text goes to the library whole: only pre-tokens do."""
    asked = []
    counts = tc.Counts(PATH, tc.whole_tokens(PATH))

    class Asked:
        def encode(self, text, **options):
            asked.append(text)
            return tc.encoder(PATH).encode(text, **options)

    counts.encoder = Asked()
    texts = ["It’s “quoted” — isn’t it?  ", "Привет, мир! Как дела 2024", "汉字 と かな 한국어", "naïve ﬁ 𝟘𝟙 😀😀 x\u2003y\u3000 z\u200b", "ĳ\u0301a ٣٤ ⅷ\x85\x1c", "a<|endoftext|>’b<|endoftext|>"]
    for text in texts:
        assert counts.count(text) == by_library(text)
    assert max(map(len, asked)) < 12 and not set(asked) & set(texts)


def test_whole_tokens_are_single():
    some = sorted(tc.whole_tokens(PATH))[::500]
    assert len(tc.whole_tokens(PATH)) > 40_000 and all(by_library(s) == 1 for s in some)


def test_operator_rows(spark):
    rows = [(1, "Hello world", "x"), (None, None, "y"), (2, "", "z"), (2, "", "z"), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(tc.token_counts(df, PATH, 1).collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(1, 11, 2, True), (None, 0, 0, False), (2, 0, 0, False), (2, 0, 0, False), (3, 0, 0, False)], key=lambda r: f"Row(doc_id={r[0]}")
    assert tc.token_counts(df.limit(0), PATH).collect() == []
