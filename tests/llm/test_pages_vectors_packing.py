import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallyspark.llm import extraction, packing, warc
from tallyspark.llm.components import components
from tallyspark.llm.html_blocks import blocks
from tallyspark.llm.vectors import near_duplicate_vectors

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ENCODER = packing.Encoder(TOKENIZER)
PLAIN = Tokenizer.from_file(TOKENIZER)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aAbzéßİı ǅΣσ.,'!-<|>\n\t\x0b\x1ć １½日ﬁ🙂‍", max_size=30))
def test_encoder_equals_the_tokenizer(text):
    (ids,) = ENCODER.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == PLAIN.encode(text, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 500), min_size=1))
def test_plan_places_every_piece_without_overlap(counts):
    slots, sequences = packing.plan(counts, 64)
    filled, placed = Counter(), Counter()
    for at, length in enumerate(slots.length.tolist()):
        same = at + 1 < len(slots.length) and slots.length[at + 1] == length
        last = int(slots.first[at + 1]) if same else counts[length]
        for rank in range(int(slots.first[at]), last):
            filled[int(slots.sequence[at]) + (rank - int(slots.first[at])) // int(slots.repeat[at])] += length
            placed[length] += 1
    assert placed == counts and max(filled.values()) <= 64 and len(filled) == sequences
    assert sequences <= -(-sum(n * c for n, c in counts.items()) // 32) + 1


def test_packing_round_trip(spark):
    texts = ["the cat", None, "", "word " * 5000, "the cat", "a, b. c!"] + [f"t {n} " * (n % 300) for n in range(400)]
    docs = spark.createDataFrame([(n % 350, t, "x") for n, t in enumerate(texts)], "doc_id long, text string, length string")
    rows = packing.pack(docs, TOKENIZER).collect()
    wanted = Counter()
    for n, text in enumerate(texts):
        ids = np.array([*PLAIN.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            cut = ids[start : start + 2048]
            wanted[n % 350, piece, start, len(cut), zlib.crc32(cut.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == wanted
    sequences = {}
    for row in rows:
        sequences.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(row["length"] for row in rows) // 2048) + 1
    assert packing.pack(docs.limit(0), TOKENIZER).collect() == []


def test_vectors_equal_brute_force(spark):
    chance = np.random.default_rng(5)
    centres = chance.normal(size=(40, 16))
    rows = []
    for n in range(900):
        centre = centres[0] if n % 3 == 0 else centres[n % 40]
        rows.append((n, (centre + 0.12 * chance.normal(size=16)).tolist(), n % 2))
    rows += [(1000 + n, rows[n][1], rows[n][2]) for n in range(50)]
    odd = [(2000, None, 1), (2001, [], 1), (2002, [0.0] * 16, 1), (2003, [float("nan")] * 16, 1)]
    odd += [(2004, [None, *[1.0] * 15], 1), (2005, rows[0][1], None), (2006, [1.0, 2.0], 1), (2007, [2.0, 4.0], 1)]
    odd += [(None, rows[0][1], 0), (2008, [1e-30] * 16, 0), (2009, [1e30] * 16, 0)]
    frame = spark.createDataFrame(
        [(*row, "x") for row in rows + odd], "vec_id long, embedding array<float>, label int, links string"
    )
    found = {row["vec_id"]: row for row in near_duplicate_vectors(frame).collect()}
    x = np.array([row[1] for row in rows], dtype=np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([row[2] for row in rows])
    alike = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    expected, got = alike.sum(axis=1) - 1, np.array([found[row[0]]["n_links"] for row in rows])
    assert (got <= expected).all() and got.sum() >= 0.97 * expected.sum()
    for n in range(2000, 2006):
        assert (found[n]["n_links"], found[n]["component_id"]) == (0, n)
    assert found[2007]["component_id"] == 2006 and found[2009]["component_id"] == 2008
    assert found[None]["component_id"] is None and len(found) == len(rows) + len(odd)
    assert near_duplicate_vectors(frame.limit(0)).collect() == []


def test_components_of_paths_loops_and_nothing(spark):
    edges = [(n, n + 1) for n in range(0, 40)] + [(50, 50), (60, 61), (61, 60), (None, 3)]
    found = components(spark.createDataFrame(edges, "a long, b long"))
    assert dict(map(tuple, found.collect())) == {**dict.fromkeys(range(1, 41), 0), 61: 60}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="sidebar-left">
<nav><a>Home</a></nav><div class="ad">Buy<p>now</div><!-- x <p>no</p> -->
<article class="has-comments"><h1>Title &amp; more</h1><p>One <b>bo</b>ld
 text<br>here<p>Two &eacute;&#33;<aside>side</aside><div id="comments"><p>c1</p></div>
<script>"</p>"</script><ul><li>i1<li>i2</ul></article><footer>&copy; f</footer>"""


def test_blocks_of_an_article():
    parts = [b.text for b in blocks(PAGE) if b.part == "article"]
    assert parts == ["Title & more", "One bold text here", "Two é!", "i1", "i2"]
    assert blocks(None) == blocks("") == [] and blocks("<") and blocks("a <b") is not None


def test_repeated_passages_go_where_no_article_is_marked(spark):
    boiler = "all of these words stand on every page of this host"
    pages = [(n, f"http://H.example/{n}", f"<p>{boiler}</p><div>only {n} here</div>", "x") for n in range(30)]
    pages += [(100, "http://other.example/", f"<p>{boiler}</p>", "x"), (101, None, None, "x"), (102, "x", "", "x")]
    pages += [(103, "http://h.example/q", f"<article><p>{boiler}</p></article>", "x")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    found = {row["page_id"]: row["text"] for row in extraction.extract(frame).collect()}
    assert [found[n] for n in range(30)] == [f"only {n} here" for n in range(30)]
    assert (found[100], found[101], found[102], found[103]) == (boiler, "", "", boiler)
    assert extraction.extract(frame.limit(0)).collect() == []


def test_articles_beside_the_text_are_not_the_text(spark):
    body = "".join(f"<p>paragraph {n} of the body of this page, which is long</p>" for n in range(9))
    remark = "<article><p>" + "a reader says a lot here " * 60 + "</p></article>"
    main = f"<main>{body}<article><h2>Teaser</h2><p>read on</p></article></main>"
    plain = f"<div>{body}</div><article>Teaser: read on</article>"
    talk = f"<article>{body}</article><section class='comments'>{remark}{remark}</section>"
    inside = f"<article>{body}<div id='comments'>{remark}<article>never closed</div><p>last</p></article>"
    loose = f"<div>{body}</div><aside><div class='related'>{remark}</div></aside>"
    tail = f"<div class='comments'>never closed<article>{body}</article>"
    pages = [(n, f"http://{n}.example/", one) for n, one in enumerate((main, plain, talk, inside, loose, tail))]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {row["page_id"]: row["text"].split("\n") for row in extraction.extract(frame).collect()}
    wanted = [f"paragraph {n} of the body of this page, which is long" for n in range(9)]
    assert all(found[n][:9] == wanted for n in range(6))
    assert [found[n][9:] for n in range(2, 6)] == [[], ["last"], [], []]


def test_covered_runs_go_and_near_copies_count_once(spark):
    def words(*of):
        return " ".join(f"w{zlib.crc32(repr((of, n)).encode())}" for n in range(30))

    top, end = words("top"), words("end")
    pages = [(n, f"http://a.example/{n}", f"<div>{top}<br>{words(n)} <span>{end}</span></div>") for n in range(4)]
    shared = "".join(f"<p>{words('shared', n)}</p>" for n in range(6))
    pages += [(10 + n, f"http://b.example/?page={n}", f"{shared}<p>{words(10 + n)}</p>") for n in range(3)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    found = {row["page_id"]: row["text"] for row in extraction.extract(frame).collect()}
    assert [found[n] for n in range(4)] == [words(n) for n in range(4)]
    article = [words("shared", n) for n in range(6)]
    assert [found[n].split("\n") for n in range(10, 13)] == [[*article, words(n)] for n in range(10, 13)]


def test_warc_links_digests_and_round_trip(spark):
    pages = spark.createDataFrame(
        [(1, "http://a/", PAGE, "x"), (2, None, None, "x")], "page_id long, url string, html string, record string"
    )
    sources = {row["page_id"]: bytes(row["record"]) for row in warc.responses(pages).collect()}
    made = warc.derivatives(warc.responses(pages)).collect()
    assert Counter((r["page_id"], r["record_type"]) for r in made) == {
        (n, kind): 1 for n in (1, 2) for kind in ("conversion", "metadata")
    }
    for row in made:
        headers, block = warc.parse(bytes(row["record"]))
        source, _ = warc.parse(sources[row["page_id"]])
        assert headers["warc-refers-to"] == row["refers_to"] == source["warc-record-id"]
        assert headers["warc-block-digest"] == warc.digest(block)
        if row["record_type"] == "metadata":
            assert f"source-payload-digest: {source['warc-payload-digest']}".encode() in block
    whole = b"".join(sources.values())
    zipped = b"".join(zlib_gzip(one) for one in sources.values())
    assert list(warc.members(whole)) == list(warc.members(zipped)) == list(sources.values())


def zlib_gzip(content):
    packer = zlib.compressobj(wbits=31)
    return packer.compress(content) + packer.flush()


@pytest.mark.parametrize("record", [None, b"", b"WARC/1.1\r\n", b"x\r\n\r\n", b"WARC/1.1\r\nContent-Length: 9\r\n\r\nab"])
def test_broken_records_give_nothing(record):
    assert warc.derive(record) == []


def test_other_status_gives_metadata_only():
    block = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html\r\n\r\n<p>x"
    record = warc.build([("WARC-Type", "response"), ("WARC-Record-ID", "<urn:x>")], block)
    ((kind, _, source, made),) = warc.derive(record)
    assert (kind, source) == ("metadata", "<urn:x>") and re.search(rb"http-status: HTTP/1.1 404", made)
