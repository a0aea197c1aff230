"""Operators on the forms that the generated tables do not hold."""

import datetime
import re

import corpus_pipeline as C
from lodeweave.llm import langid, media, pii


def test_dates_of_all_layouts():
    p = pii.Pseudonymiser(b"key")
    text = "12/31/1999, 1/5/1999, 5/31/1999, 31.1.1999, 1-12-1999, 01/5/1999, 1.05.1999 and 1999-01-05; not 13/32/1999, 0/5/1999, 1/5/1899 or 1.5.1999.2"
    new, spans = p.apply(text)
    found = [text[a:b] for a, kind, b in spans if kind == "date"]
    assert found == ["12/31/1999", "1/5/1999", "5/31/1999", "31.1.1999", "1-12-1999", "01/5/1999", "1.05.1999", "1999-01-05"] and len(spans) == 8
    shape = lambda t: re.sub("[0-9]", "9", t)
    for old in found:
        got = p.apply(old)[0]
        assert got != old and got in new and shape(got) == shape(old)
    month, day, year = map(int, p.apply("12/31/1999")[0].split("/"))
    assert day > 12 and datetime.date(year, month, day)
    assert p.apply("05.01.1999")[0].split(".") == p.apply("1999-01-05")[0].split("-")[::-1]


def test_dates_do_not_collide():
    p, day = pii.Pseudonymiser(b"key"), datetime.date(2000, 1, 1)
    texts = set()
    for i in range(366):
        x = day + datetime.timedelta(i)
        for d, m in ((f"{x.day}", f"{x.month}"), (f"{x.day:02d}", f"{x.month:02d}"), (f"{x.day:02d}", f"{x.month}")):
            texts |= {f"{d}/{m}/2000", f"{m}/{d}/2000"}
    news = {p.apply(t)[0] for t in texts}
    assert len(news) == len(texts) and all(len(p.apply(t)[1]) == 1 for t in news)


def pieces(text):
    p = pii.Pseudonymiser(b"key")
    new, spans = p.apply(text)
    assert all(p.apply(text[a:b])[0] in new for a, _, b in spans)  # the same pseudonym as alone
    return [(kind, text[a:b]) for a, kind, b in spans]


def test_ibans_before_other_tokens():
    for iban in ("BE68 5390 0754 7034", "BE68539007547034", "AT61 1904 3002 3457 3201", "DE89 3704 0044 0532 0130 00", "ES91 2100 0418 4502 0005 1332"):
        for tail in ("", " EUR", " BIC", " A", " 12", " 2024", " EUR 12", " 2024 INVOICE", ", EUR", " x"):
            assert pieces(iban + tail) == [("iban", iban)], iban + tail
    assert pieces("BE68539007547034EUR") == [("iban", "BE68539007547034")]
    assert pieces("REF AB12 3456 7890 BE68 5390 0754 7034 EUR") == [("iban", "BE68 5390 0754 7034")]
    assert pieces("BE68 5390 0754 7034 EUR@x.org") == [("iban", "BE68 5390 0754 7034"), ("email", "EUR@x.org")]
    assert pieces("BE68 5390 0754 7035 EUR") == []


def test_cards_before_other_numbers():
    for card in ("4111 1111 1111 1111", "4111-1111-1111-1111"):
        for tail in ("", " 123", " 12/25", " 1", " 2024", " 4", "-99"):
            assert pieces(card + tail) == [("card", card)], card + tail
    assert pieces("2024 4111 1111 1111 1111") == [("card", "4111 1111 1111 1111")]
    assert pieces("3782 822463 10005, 3782-822463-10005 and 3056 930902 5904 123") == [("card", "3782 822463 10005"), ("card", "3782-822463-10005"), ("card", "3056 930902 5904")]
    assert pieces("4111 1111 1111 1111 110") == [("card", "4111 1111 1111 1111")]
    assert pieces("1234 5678 9012 3456 7890") == [] and pieces("1234 5678 9012 3456 123") == [("card_like", "1234 5678 9012 3456")]
    assert pieces("4000 0000 0000 0000 006") == [("card", "4000 0000 0000 0000 006")]  # 19 digits with a right check digit
    p = pii.Pseudonymiser(b"key")
    assert p.apply("3782 822463 10005")[0].replace(" ", "") == p.apply("378282246310005")[0]


def kept(spark, rows):
    docs = spark.createDataFrame([(i, text, lang, "a", None) for i, (text, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    return {r.text for r in C.language(spark, docs, "").collect()}


def test_language_stage_without_labels(spark):
    texts = ["a clean text", "日本語", "é", "123 !!", "²", "", None]
    letters = {"a clean text", "日本語", "é"}
    assert kept(spark, [(t, None) for t in texts]) == letters
    assert kept(spark, [(t, None) for t in texts] + [(None, "en"), (None, "de")]) == letters
    assert kept(spark, [(t, None) for t in texts] + [("42", "en"), ("4711", "de")]) == letters


def test_language_limit_follows_the_number_of_languages(spark):
    assert C.least_score(4) == 0.3
    assert all(1 / k < C.least_score(k) < 1 for k in range(2, 300)) and C.least_score(1) <= 1
    own = ["abab", "cdcd", "efef", "ghgh", "ijij", "klkl", "mnmn", "opop"]
    far = "ЖЖЖ"  # of a script that no language has
    for k in (1, 2, 3, 4, 8):
        rows = [(f"{w} {w} {w}", f"l{i}") for i, w in enumerate(own[:k])]
        got = kept(spark, [*rows, (far, None)])
        assert {t for t, _ in rows} <= got and (far in got) == (k == 1)
    related = [(f"{w} {w} {'yzyz yzyz' if i < 4 else w}", f"l{i}") for i, w in enumerate(own)]  # four of eight share a word
    docs = spark.createDataFrame(related, "text string, lang string")
    assert langid.train(docs).predict(["yzyz"])[0][1] < 0.3
    assert "yzyz" in kept(spark, [*related, ("yzyz", None)])


def items(page):
    found = media.parse_items(page)
    assert [i["position"] for i in found] == list(range(len(found)))
    return [i["text"] if i["kind"] == "text" else (i["digest"], i["caption"]) for i in found]


def test_captions_wherever_they_stand():
    assert items("<figure><figcaption>Text</figcaption><img src=a></figure>after") == [("a", "Text"), "after"]
    assert items("<figure><img src=a alt=A><figcaption>Text</figcaption><img src=b></figure><img src=c alt=C>") == [("a", "Text"), ("b", "Text"), ("c", "C")]
    assert items("<figure><figcaption>Table 1</figcaption><table><tr><td>x</td></tr></table></figure>") == ["Table 1", "x"]
    assert items("<figure><pre>code</pre><figcaption><p>List</p><p>ing</p></figcaption></figure>") == ["code", "List ing"]
    assert items("<figcaption>No figure</figcaption><img src=a>") == ["No figure", ("a", None)]
    assert items("<figure><img src=a alt=A><figcaption> </figcaption></figure>") == [("a", "A")]


def test_open_captions_end():
    assert items("<figure><img src=a><figcaption>Text</figure><p>rest</p><img src=b>") == [("a", "Text"), "rest", ("b", None)]
    assert items("<figure><pre>x</pre><figcaption>Text</figure><p>rest") == ["x", "Text", "rest"]
    assert items("<figure><figcaption>Text <p>rest") == ["Text rest"]
    assert items("<figure><figcaption>Text<img src=a>") == [("a", "Text")]
    assert items("<figcaption>Text<p>rest") == ["Text", "rest"]
    assert items("</figure></figcaption>x") == ["x"]


def test_figures_in_figures():
    inner = "<figure><img src=a><figcaption>A</figcaption></figure>"
    assert items(f"<figure>{inner}<figure><img src=b></figure><figcaption>Both</figcaption></figure>") == [("a", "A"), ("b", "Both")]
    assert items(f"<figure>{inner}<figcaption>Outer</figcaption></figure>") == [("a", "A"), "Outer"]


def test_all_languages_are_learned(spark):
    name = lambda i: "".join(chr(97 + int(c)) for c in f"{i:03d}")
    docs = spark.createDataFrame([(f"x{name(i)} x{name(i)}", f"l{i:03d}") for i in range(300)], "text string, lang string")
    model = langid.train(docs)
    assert len(model.languages) == 300
    assert model.predict([f"x{name(i)}" for i in range(300)]) == [(f"l{i:03d}", p) for i, (_, p) in enumerate(model.predict([f"x{name(i)}" for i in range(300)]))]


def test_sample_is_bounded_for_many_languages(spark):
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i:04d}")
    docs = spark.createDataFrame([(word(i), f"l{i % 4}") for i in range(4_000)], "text string, lang string")
    words = lambda m: int((m.kinds == 0).sum())
    assert words(langid.train(docs)) == 4_000 and 600 < words(langid.train(docs, total=800)) < 1_100 and 100 < words(langid.train(docs, total=4)) < 400


def test_copies_do_not_shrink_the_sample(spark):
    word = lambda i: "".join(chr(97 + int(c)) for c in f"{i:03d}")
    rows = [("copy copy", "en")] * 1_100 + [(f"{word(i)} {word(i)}", "en") for i in range(100)]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), rows=400)
    assert (model.kinds == 0).sum() == 101
