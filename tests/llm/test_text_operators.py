"""Toxicity, licenses, main text, media and pieces: edge cases and exact models of them."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from glyphlake.llm import html, licenses, media, pieces, toxicity
from glyphlake.llm.queries import TOKENIZER_MODEL

EDGES = [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x"), (4, "ab " * 60_000)]


def docs(spark, data=EDGES):
    return spark.createDataFrame([(i, t, 7, "clash") for i, t in data], "doc_id long, text string, score int, labels string")


def test_edges_of_every_text_operator(spark):
    some, none = docs(spark), docs(spark, [])
    runs = {
        "licenses": licenses.scan_licenses,
        "media": media.digests,
        "pieces": lambda d: pieces.encode(d, TOKENIZER_MODEL),
        "html": lambda d: html.extract_main_text(d.withColumn("url", F.lit(None).cast("string")), "doc_id", "url", "text"),
    }
    for name, run in runs.items():
        assert run(some).count() == len(EDGES), name
        assert run(none).count() == 0, name


def distance(a, b):
    """Edits between two words, a swap of neighbours counting one."""
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_finds_what_the_distance_says():
    random.seed(2)
    terms = {"idiot": 5.0, "moron": 5.0, "scum": 5.0, "worthless": 5.0}
    lexicon = toxicity.Lexicon(terms, {})
    for _ in range(3000):
        word = list(random.choice(list(terms)))
        for _ in range(random.randint(0, 3)):
            at = random.randrange(len(word) + 1)
            word[at : at + random.randint(0, 1)] = random.choice(["", "x", "o"])
        if word and random.random() < 0.3:
            i = random.randrange(max(1, len(word) - 1))
            word[i : i + 2] = word[i : i + 2][::-1]
        word = "".join(word)
        best = min((distance(word, t) for t in terms if distance(word, t) <= toxicity._edits(len(t))), default=None)
        got = lexicon.find(word)
        assert (got[1] if got else None) == best, word


def test_stems_hold_for_all_their_words():
    lexicon = toxicity.Lexicon({}, {"lowe": 4.0})
    assert lexicon.find("loweichen") == (4.0, 0) and lexicon.find("lowe") == (4.0, 0) and lexicon.find("low") is None


def test_rarer_terms_are_found_misspelled():
    lexicon = toxicity.Lexicon({"wretched": 8.0, "rotten": 4.0, "vile": 4.0}, {})
    assert lexicon.find("rottem") == (4.0, 1) and lexicon.find("wretchde") == (8.0, 1) and lexicon.find("vils") is None


def test_toxicity_learns_and_tells_quotation(spark):
    random.seed(4)
    plain = "the of and thing other words here that with from".split()
    data, labels = [], []
    for i in range(400):
        words = [random.choice(plain) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[random.randrange(30)] = random.choice(["vile", "rotten", "wretched"])
        data.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    d = spark.createDataFrame(data, "doc_id long, text string")
    model = toxicity.learn(d, spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score_documents(d, model).collect()}
    assert all(got[i].predicted == y and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, y in labels)
    assert model.score("you wretchde person, wretched rottem thing and wretched") > 0.5 > model.score("")
    assert model.score('he said "rotten" of it') < model.score("you are rotten of it")
    edges = toxicity.score_documents(docs(spark), model)
    assert edges.count() == len(EDGES) and edges.where("score is null or score < 0 or score > 1").count() == 0
    empty = toxicity.learn(d.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.score("anything") < 0.5


def test_base_phrases_match_brute_force(spark):
    random.seed(6)
    vocabulary = "under the mit license apache version 2 cc by nc x".split()
    texts = [" ".join(random.choice(vocabulary) for _ in range(random.randint(0, 60))) for _ in range(300)]
    got = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        words = t.split()
        places = [(k, label) for p, label in licenses.BASE_PHRASES.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r.base_labels == ",".join(sorted({label for _, label in places})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_templates():
    a = licenses.Automaton("one <<beginOptional>>two <<endOptional>>three <<var;max=2>> four")
    accepts = {"one three four": 3, "one two three x four": 5, "one three x y four": 5, "one three x y z four": -1, "one two four": -1, "one two": -1}
    for text, end in accepts.items():
        assert a.end(licenses.words_of(text), 0) == end, text


@pytest.mark.parametrize(
    "page, text",
    [
        ("", ""),
        (None, ""),
        ("plain &amp; <b>bold</b>er", "plain & bolder"),
        ("<body><nav><a href=x>menu</a></nav><article><h1>T&eacute;</h1><p>one\n two<p>three<br>four</article><footer>f</footer>", "Té one two three four"),
        ("<body><div class='ad'>Buy this fine thing now please</div><div id=story><p>First long paragraph of it.</p><p>Second long paragraph of it.</p></div><div class=sidebar><a href=x>l</a></div>", "First long paragraph of it. Second long paragraph of it."),
        ("<article><p>a</p><section class='comments'><p>reader</p></section><script>x='</p>'</script><aside>no</aside><form>f</form><p>b</p></article>", "a b"),
    ],
)
def test_main_text(page, text):
    assert html.main_text(page) == text


def test_media_round_trip(spark):
    texts = ["", "é" * 100, "x" * 192 * 41, "y" * 193]
    d = spark.createDataFrame([*enumerate(texts), (9, None), (10, "")], "doc_id long, text string")
    for r in media.digests(d).collect():
        raw = (texts[r.doc_id] if r.doc_id < 4 else "").encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    columns = {r.id: r for r in media.media_columns(media.text_media(d), "id", "content").collect()}
    assert columns[2].codec == "raw " and columns[2].n_samples == 41 and columns[2].duration_s == 41 / 25
    data = media.packed(media.padded(texts[2])[0])
    assert [data[k.start : k.start + k.length] for k in columns[2].keyframes] == [b"x" * 192] * 4
    broken = spark.createDataFrame([(1, None), (2, b""), (3, bytes(data[:200])), (4, b"\0\0\0\x08moov")], "id long, content binary")
    assert media.media_columns(broken, "id", "content").where("n_samples = 0 and codec is null").count() == 4


def test_pieces_are_the_librarys(spark):
    import sentencepiece

    random.seed(1)
    library = sentencepiece.SentencePieceProcessor(model_file=TOKENIZER_MODEL)
    texts = ["", " ", "a", "  a  b", "é\n\tx", "日本 語😀", "Ａ", "x" * 300 + " " * 40 + "y", "\0a", "e\u0301"]
    texts += ["".join(random.choice("ab c  \n.日é😀▁\t0the ing") for _ in range(random.randint(0, 200))) for _ in range(150)]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    encoded = pieces.encode(d, TOKENIZER_MODEL)
    for r in encoded.collect():
        assert r.token_ids == library.encode(texts[r.doc_id]) and r.n_tokens == len(r.token_ids) and r.round_trip == ("▁" not in texts[r.doc_id])
    for r in pieces.decode(encoded, TOKENIZER_MODEL).collect():
        assert r.text == texts[r.doc_id].replace("▁", " ")


def test_damaged_containers_are_null(spark):
    """Sample counts beyond the file, and boxes nested without end."""
    whole = media.packed(media.padded("some text")[0])
    at = whole.index(b"stsz")
    many = whole[: at + 8] + (1).to_bytes(4, "big") + (2**32 - 1).to_bytes(4, "big") + whole[at + 16 :]
    deep = b"".join((8 * (3000 - i)).to_bytes(4, "big") + b"moov" for i in range(3000))
    rows = media.media_columns(spark.createDataFrame([(1, many), (2, deep), (3, whole[:-300]), (4, None), (5, whole)], "id long, content binary"), "id", "content").collect()
    got = {r.id: r for r in rows}
    assert all(got[i].codec is None and got[i].n_samples == 0 for i in (1, 2, 4)) and got[5].n_samples > 0


def test_template_markup_of_published_licenses():
    a = licenses.Automaton('Copyright <<var;name="c";original="x > y";match=".{0,100}">> all <<beginOptional;name="t">>rights <<endOptional>>reserved')
    words = licenses.words_of
    assert a.end(words("copyright all reserved"), 0) == 3 and a.end(words("copyright 2020 a b all rights reserved x"), 0) == 7
    any_ = licenses.Automaton('a <<var;name="x";original="";match=".+">> b')
    assert any_.end(words("a b"), 0) == -1 and any_.end(words("a " + "w " * 900 + "b"), 0) == 902
    for broken in ("<<endOptional>>", "<<beginOptional>> a"):
        with pytest.raises(ValueError):
            licenses.Automaton(broken)


def test_declarations_end_no_page():
    assert html.main_text("<![foo[x]]>t") == "t" and html.main_text("<p>a<!foo>b") == "ab" and html.main_text("<![") in ("", "<![")


def test_ids_outside_the_model_fail(spark):
    with pytest.raises(Exception, match="outside the model"):
        pieces.decode(spark.createDataFrame([(1, [10**6])], "doc_id long, token_ids array<int>"), TOKENIZER_MODEL).collect()


def test_density_decides_not_the_name_of_an_element():
    rows = "<tr><td>1</td><td>2</td></tr>" * 3
    page = (
        "<html><body><nav><a href=x>Menu</a></nav><div class=ad>Buy</div>{open}<header><h1>A title</h1></header><p><b>" + "All of it is bold. " * 20 + "</b></p>"
        "<section><h2>More</h2><p>" + "A second part of some length. " * 9 + f"</p></section><table>{rows}</table><p>Short end.</p>" + "{close}<aside>Other <a href=y>links</a></aside><footer>End</footer></body></html>"
    )
    texts = {html.main_text(page.format(open=a, close=b)) for a, b in (("<article>", "</article>"), ("<main>", "</main>"), ("<div>", "</div>"), ("<div><div>", "</div></div>"))}
    (text,) = texts
    assert text.startswith("A title All of it") and text.endswith("1 2 1 2 1 2 Short end.") and "Menu" not in text and "links" not in text


def test_all_stretches_of_a_text_in_one_pass():
    random.seed(12)
    templates = ['<<var;match=".+">> b', 'a <<var;match=".*">> b', 'a <<beginOptional>>b <<endOptional>><<var;match=".{0,7}">> c', '<<beginOptional>>a <<endOptional>>b', '<<var;max=2>> c', 'a b a']
    for template in templates:
        a = licenses.Automaton(template)
        for _ in range(60):
            words = [random.choice([b"a", b"b", b"c", b"d"]) for _ in range(random.randrange(14))]
            places = {w: [i for i, x in enumerate(words) if x == w] for w in set(words)}
            covered = {k for s, e in a.spans(words, places) for k in range(s, e)}
            want = {k for i in range(len(words)) for k in range(i, a.end(words, i))}
            assert covered == want, (template, words)
    loose = licenses.Automaton('start <<var;match=".*">> finish')
    words = [b"start", b"x"] * 40_000  # quadratic work would not end here
    assert loose.spans(words, {b"start": list(range(0, len(words), 2))}) == []
    assert licenses.Automaton('a <<var;match=".{0,9000}">> b').end([b"a", *[b"w"] * 4000, b"b"], 0) == 4002


RUNNING_TEXT = "".join(f"<p>Running words of the article, number {i}, which go on for a while so that there is enough of them.</p>" for i in range(8))


@pytest.mark.parametrize(
    "page, first, gone",
    [
        (f'<nav><a href=x>Home</a></nav><div class="with-sidebar"><article><h1>Title</h1>{RUNNING_TEXT}</article><div class="sidebar"><a href=y>More</a> aside</div></div>', "Title Running", "aside"),
        (f'<div class="with-sidebar"><div class="post"><h1>Title</h1>{RUNNING_TEXT}</div><div class="sidebar">aside</div></div>', "Title Running", "aside"),
        (f'<div><article><header class="entry-header"><h1>Title</h1></header>{RUNNING_TEXT}</article></div>', "Title Running", "-"),
        (f'<div><article><div class="article-header"><h1>Title</h1></div>{RUNNING_TEXT}</article></div>', "Title Running", "-"),
        (f'<div class="site-header"><h1>Site</h1></div><div><article><h1>Title</h1>{RUNNING_TEXT}</article></div>', "Title Running", "Site"),
        (f'<div><article><h1>Title</h1><p class="social-history">Social history.</p>{RUNNING_TEXT}<p class="cookie-notice">Cookies.</p></article></div>', "Title Social history. Running", "Cookies"),
        (f'<div><article><h1>Title</h1>{RUNNING_TEXT}</article><section id="comments"><h2>Comments</h2>{RUNNING_TEXT.replace("article", "reader") * 3}</section></div>', "Title Running", "reader"),
        ('<div class="ad">An advert that has many more words than the text.</div><article><p>A short text.</p></article>', "A short text.", "advert"),
    ],
)
def test_names_are_evidence_only(page, first, gone):
    text = html.main_text(f"<html><body>{page}</body></html>")
    assert text.startswith(first) and gone not in text


def test_depth_takes_no_square_of_time():
    deep = 60_000  # climbing all open elements at every tag would not end here
    assert html.main_text("<blockquote>" * deep + "x") == "x" and html.main_text("<div>" * deep + "</q>" * deep + "x") == "x"
