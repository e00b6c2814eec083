"""Token ids and visual forms."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import token_ids as T
from orrery.llm import visual_form as V

TEXTS = ["", "Hello world", "<|endoftext|> is plain text", "á bé 你好，世界。", "x" * 5000, " \n\t    y", "don't  stop\r\n", "\u0000\u0007 control", "\U0001f469‍\U0001f52c!"]


def test_ids_equal_the_tokenizers_own(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{T.TOKENIZERS}/byte_bpe_50k.json")
    own.encode_special_tokens = True
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(90, None, 1), (None, "free", 1), (1, "Hello world", 1)]
    got = T.token_ids(spark.createDataFrame(rows, "doc_id long, text string, ids int")).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: list(r.ids) for r in got}
    assert by[90] == [] and by[0] == []
    for i, t in enumerate(TEXTS):
        assert by[i] == own.encode(t, add_special_tokens=False).ids


def test_long_texts_in_pieces_give_the_same_ids():
    enc = T.encoding("byte_bpe_50k")
    text = ("It's 3.5 times\n\n faster,  isn't it? 你好。世界，42 " * 300) + "tail"
    for size in (10, 37, 1000):
        assert [i for p in T.pieces(text, size) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)
        assert "".join(T.pieces(text, size)) == text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab1 \n\t'sd.,。é你 ½"), max_size=80))
def test_any_cut_at_a_safe_place_changes_nothing(text):
    enc = T.encoding("byte_bpe_50k")
    assert [i for p in T.pieces(text, 3) for i in enc.encode_ordinary(p)] == enc.encode_ordinary(text)


def test_round_trip(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in T.texts_of(T.token_ids(df)).collect()} == dict(enumerate(TEXTS))
    assert T.token_ids(df.where("doc_id < 0")).count() == 0
    assert all(r.same for r in T.round_trips(df).collect())


SAME = [
    ("café", "café"), ("name", "nаme"), ("a b", "a b"), ("a b", "a b"), ("word", "wo​rd"), ("word", "﻿wo­rd"), ("ABC 12", "ＡＢＣ　12"), ("ラフ", "ﾗﾌ"),
    ("ガ", "ｶﾞ"), ("office", "oﬃce"), ("5 µm", "5 μm"), ("10 Ω", "10 Ω"), ("well-known", "well‑known"), ("ёл", "ёл"), ("a\nb", "a\r\nb"), ("ế", "ế"), ("ệ", "ệ"), ("SEX", "ЅΕΧ"),
]
APART = [("Name", "name"), ("resume", "résumé"), ("m2", "m²"), ("1", "①"), ("X", "\U0001d54f"), ("straße", "strasse"), ("a-b", "a−b"), ("a b", "a  b"), ("a b", "ab"), ("a.", "a"), ("\U0001f469‍\U0001f52c", "\U0001f469\U0001f52c"), ("1/2", "½"), ("O", "0"), ("a\nb", "a b"), ("3", "٣")]


#: Letters of other scripts that the published data calls confusable.
SAME += [("so", "s\u0585"), ("A1", "\u13aa1"), ("pa", "\u03c1a"), ("P", "\u2ca2")]


@pytest.fixture(scope="module")
def forms(spark):
    return V.Forms(V.look_alike_letters(spark))


@pytest.mark.parametrize("a, b", SAME)
def test_same_to_the_eye(forms, a, b):
    assert forms.visual(a) == forms.visual(b) and forms.folded(a) == forms.folded(b)


@pytest.mark.parametrize("a, b", APART)
def test_apart_to_the_eye(forms, a, b):
    assert forms.visual(a) != forms.visual(b)


LETTERS = st.one_of(st.characters(), st.sampled_from("aA\u0410\u0391\u0301\u200d\u200b\xad\u2011\xa0\u3000\r\n\t\u0130\u0131\xdf\u1e9e\ufb01\u2460\xb2\uff21\uff76\uff9e\u212b\u2126\xb5\u0345\u03c2\U0001f469\U0001f52c\uffff\x00\x01"))


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=LETTERS, max_size=30))
def test_forms_are_settled(forms, text):
    v = forms.visual(text)
    if V.KEPT_JOINER not in v:
        assert forms.visual(v) == v
    assert forms.folded_all([text]) == [forms.folded(text)]
    # texts of one visual form have one comparison form, so no pair is lost
    assert forms.folded(v) == forms.folded(text)


def test_pairs(spark):
    rows = [(1, "café au lait"), (2, "café au lait"), (3, "café au lait"), (4, "Café au lait"), (5, None), (6, ""), (7, " "), (8, " "), (9, "​"), (10, "other"), (2, "café au lait"), (None, "café au lait"), (11, "ｏｔｈｅｒ")]
    df = spark.createDataFrame([(*r, "f", "v") for r in rows], "doc_id long, text string, folded string, visual string")
    assert {(r.doc_a, r.doc_b) for r in V.look_alikes(df).collect()} == {(1, 2), (2, 3), (10, 11)}
    classes = {r.doc_id: (r.class_id, r.spelling_id) for r in V.look_classes(df).collect()}
    assert classes == {1: (1, 1), 2: (1, 2), 3: (1, 1), 10: (10, 10), 11: (10, 11)}
    texts = {r.doc_id: r for r in V.consistent_texts(df).collect()}
    assert texts[2].visual == "café au lait" and texts[4].folded == texts[1].folded and texts[5].folded is None and texts[9].visual is None
    assert V.look_alikes(df.where("doc_id < 0")).count() == 0


def test_many_copies_of_two_spellings_give_one_row_each(spark):
    df = spark.range(600).selectExpr("id AS doc_id", "if(id % 2 = 0, 'name', 'n\u0430me') AS text")
    assert V.look_classes(df).count() == 600 and V.look_alikes(df).count() == 300 * 300
