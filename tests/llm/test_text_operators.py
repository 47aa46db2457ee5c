import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.llm import language, mixing, personal, quality, toxicity

ODD = [None, "", " \n\t", "12 34", "x" * 50_000, "a b " * 5000]
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + at % 2) for at, d in enumerate(reversed(digits))]
    return sum(n - 9 if n > 9 else n for n in doubled) % 10 == 0


def base_spans(text):
    found = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for match in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", match[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(part) <= 255 for part in match[0].split(".")),
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((match.start(), order, match.end(), kind))
    return sorted(found)


def test_base_spans_equal_the_plain_patterns(spark):
    texts = [
        *ODD,
        "Ä🙂 a.b@c.d_e@f.gh, x@y, a@b..c a@b.c.@d.e @a.b ..@x.y",
        "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 1.2.3 999999.1.1.1",
        "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111 5 5  5",
        "+1 (555) 010-9999 ++4912345678901 +1 2 +12((((( +123456789012345678",
        "password=abcdef123456 call (555) 555-0100 James Miller",
    ]
    rows = spark.createDataFrame(
        [(n, text, "s") for n, text in enumerate(texts)], "doc_id long, text string, spans string"
    )
    for row in personal.digest(rows, personal.learn(rows)).collect():
        wanted = base_spans(texts[row["doc_id"]])
        listed = ",".join(f"{kind}:{start}:{end}" for start, _, end, kind in wanted)
        assert row["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest(), row
        counts = Counter(kind for *_, kind in wanted)
        assert [row[f"n_{kind}"] for kind in PATTERNS] == [counts[kind] for kind in PATTERNS]
        assert set(filter(None, listed.split(","))) <= set(row["spans"].split(","))


def test_redaction_takes_effect_and_leaves_clean_text(spark):
    rows = spark.createDataFrame([("Ä mail a@b.com or +1 555 010 9999.",), ("clean",), (None,)], ["text"])
    model = personal.learn(rows)
    found = [row[0] for row in rows.select(personal.redacted(F.col("text"), model)).collect()]
    assert found == ["Ä mail [EMAIL] or [PHONE].", "clean", None]


def test_long_secrets_are_redacted_whole(spark):
    secret = "a1B2" * 100
    rows = spark.createDataFrame([(1, f"token={secret} stays")], "doc_id long, text string")
    clean = rows.select(personal.redacted(F.col("text"), personal.learn(rows))).first()[0]
    assert "a1B2" not in clean and clean.endswith("stays")


def test_em_finds_the_reliable_labelers():
    rows = [((1, 1, 1, 1), 80), ((-1, -1, 0, -1), 60), ((1, -1, 0, -1), 30), ((1, 1, 0, 1), 20)]
    posterior, trust, _ = personal.expectation_maximisation(rows)
    assert posterior[1, 1, 1, 1] > 0.9 > 0.1 > posterior[-1, -1, 0, -1]
    assert trust[1][1, 1] > trust[0][1, 1] - 0.2


def test_no_span_rows(spark):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert personal.digest(rows, personal.learn(rows)).collect() == []


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = language.held_out(F.col("doc_id"))
    learned = language.learn(
        docs.where(~held).select(F.col("doc_id").alias("key"), "text", F.col("lang").alias("language"))
    )
    right = language.identify(docs.where(held), learned).select(
        F.avg((F.col("__language") == F.col("lang")).cast("int"))
    )
    assert right.first()[0] > 0.97


@pytest.mark.parametrize("key", ["cast(null as bigint)", "7L", "id"])
def test_language_sample_is_bounded_and_not_of_copies(spark, monkeypatch, key):
    monkeypatch.setattr(language, "SAMPLE_ROWS", 40)
    read = []
    collect = type(spark.range(1)).collect
    monkeypatch.setattr(
        type(spark.range(1)), "collect", lambda frame: read.append(collect(frame)) or read[-1]
    )
    text = "case when id % 3 = 0 then 'a copied notice' else 'word ' || id end"
    made = language.learn(spark.range(3000).selectExpr(f"{key} key", f"{text} text", "'en' language"))
    lines = made["en"].decode().split("\n")
    assert len(lines) == len(set(lines)) == 40 and max(map(len, read)) <= 40


def test_language_dictionaries_hold_all_rows_and_no_shared_header(spark):
    rows = spark.range(400).selectExpr(
        "id key", "repeat('header ', 30) || repeat('日本語の文' || id || ' ', 200) text", "'ja' language"
    )
    lines = language.learn(rows)["ja"].decode().split("\n")
    assert len(lines) == 400 and sum("header" in line for line in lines) < 100
    assert all(len(line) > 40 for line in lines)


def test_language_of_odd_texts():
    classifier = language.Classifier({"en": b"the and of this that with " * 20, "de": b"der die und das nicht " * 20})
    assert [classifier.classify(text)[0] for text in ODD[:4]] == ["und"] * 4
    assert classifier.classify("the and of this that")[0] == "en"
    assert classifier.classify("der die und das nicht")[0] == "de"
    assert 0 <= classifier.classify("x" * 50_000)[1] <= 1
    assert language.Classifier({}).classify("text") == ("und", 0.0, 0.0)


def test_mix_reaches_targets_and_reruns_agree(spark):
    docs = spark.createDataFrame(
        [(n, " ".join(["w"] * (n % 13)), ["b", "a", None, "small"][min(3, n % 100)], "x") for n in range(2000)]
        + [(1, "w w", "b", "x"), (None, "w", "a", "x"), (5000, None, "null text", "x")],
        "doc_id long, text string, source string, size string",
    )
    rows = mixing.mix(docs).select("doc_id", "source", "__mix.*").collect()
    assert rows == mixing.mix(docs).select("doc_id", "source", "__mix.*").collect()
    assert len(rows) == docs.count() and all(row["taken"] <= 3 * row["size"] for row in rows)
    taken, target = Counter(), {}
    for row in rows:
        taken[row["source"]] += row["taken"]
        target[row["source"]] = row["target"]
    assert sum(target.values()) == pytest.approx(sum(row["size"] for row in rows))
    for source, wanted in target.items():
        assert abs(taken[source] - wanted) <= 3, (source, taken[source], wanted)
    assert mixing.taken(docs).count() == sum(row["copies"] for row in rows)
    assert mixing.mix(docs.limit(0)).collect() == []


def test_grammar_reads_clauses():
    grammar = toxicity.Grammar(toxicity.lexicon(["blorg"]))
    kinds = dict(zip(toxicity.KINDS, range(5), strict=True))

    def kind(text):
        counts = grammar.all_counts(text)
        return next((name for name, at in kinds.items() if counts[at]), None)

    assert kind("you are a stupid idiot") == "targeted"
    assert kind("an idiot like you") == "targeted"
    assert kind("what an idiot") == kind("a blorg") == "plain"
    assert kind("you are not an idiot") == "negated"
    assert kind("she said he was an idiot") == "reported"
    assert kind("I will kill you") == "threat"
    assert kind("the kill switch") is kind("") is kind(None) is None
    assert grammar.all_counts("idiot. moron! scum? trash; loser")[kinds["plain"]] == 5
    for threat in ("you will die", "you should die", "you will be killed", "they must be hanged",
                   "you'll get stabbed", "I hope you die", "I want you dead", "tu vas mourir",
                   "you deserve to be beaten", "stabbing you", "he kills you", "die, you"):
        assert kind(threat) == "threat", threat
    for harmless in ("he was killed", "the leaves will die", "she will be here", "you die",
                     "sie will die Welt sehen", "they were beaten at chess", "dead ends"):
        assert kind(harmless) is None, harmless
    assert kind("you will not die") == "negated"
    assert kind("you idiot, he said") == kind("I will kill you, said Tom") == "reported"
    assert kind("he said you will die") == "reported"
    assert kind("you said I am the idiot you know well") == "reported"
    assert kind("you called me names, you filthy little idiot") == "reported"
    assert kind("you idiot said nothing to me") == "targeted"


def test_verb_forms():
    assert toxicity.inflected("kill") == (["kill", "kills", "killing"], "killed")
    assert toxicity.inflected("stab") == (["stab", "stabs", "stabbing"], "stabbed")
    assert toxicity.inflected("rape") == (["rape", "rapes", "raping"], "raped")
    assert toxicity.inflected("punish") == (["punish", "punishes", "punishing"], "punished")
    assert toxicity.inflected("burn") == (["burn", "burns", "burning"], "burned")


def test_toxicity_orders_and_bounds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "you idiot"), (None, "x")], "doc_id long, text string")
    rows = toxicity.score_toxicity(
        docs.select("doc_id", "text").union(odd), labels, language.held_out(F.col("doc_id"))
    ).collect()
    assert all(0 <= row["score"] <= 1 for row in rows)
    by_id = {row["doc_id"]: row["predicted"] for row in rows}
    assert (by_id[-1], by_id[-2], by_id[-3]) == (0, 0, 1)


def test_more_threats_score_higher(spark):
    counts = [1, 3, 4, 12, 13, 60]
    docs = spark.createDataFrame(
        [(n, "I will kill you. " * n) for n in counts], "doc_id long, text string"
    )
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, labels, F.lit(False)).orderBy("doc_id").collect()
    scores = [row["score"] for row in rows]
    assert [row["threat"] for row in rows] == counts
    assert scores == sorted(set(scores))


def test_quality_counts_equal_a_plain_count():
    hasher = quality.WordHasher()
    texts = ["a b\nc #1 | <d>\na b\n\n \na b", "é ü " * 9, "one two three four five six seven eight " * 3]
    texts += [text for text in ODD if text]
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        covered = {
            k + j
            for k in range(len(words) - 7)
            if windows[tuple(words[k : k + 8])] > 1
            for j in range(8)
        }
        lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        assert quality.rule_counts(text.encode(), hasher) == (
            len(words),
            sum(map(len, words)),
            len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)),
            len(covered),
        )
    assert quality.rule_counts(None, hasher) == (0, 0, 0, 0, 0)


def test_quality_model_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.judge(docs, labels.where(F.col("doc_id") % 2 == 0)).join(
        labels.where(F.col("doc_id") % 2 == 1), "doc_id"
    )
    right = rows.select(F.avg((F.col("kept") == (F.col("quality") == 1)).cast("int"))).first()[0]
    assert right > 0.9
    alone = quality.judge(docs, labels.limit(0))
    assert alone.where(F.col("kept") == F.col("base_failed")).count() == 0


def test_quality_model_learns_from_long_texts(spark):
    def long_text(n, words):
        return " ".join(f"{words[k % 4]}{zlib.crc32(b'%d %d' % (n, k)) % 997}" for k in range(4000))

    words = ("alder birch cedar maple".split(), "prize click bonus offer".split())
    docs = spark.createDataFrame(
        [(n, long_text(n, words[n % 2])) for n in range(120)], "doc_id long, text string"
    )
    assert docs.where(F.length("text") <= 20_000).count() == 0
    labels = docs.where("doc_id < 80").selectExpr("doc_id", "cast(doc_id % 2 = 0 as int) quality")
    rows = quality.judge(docs, labels).where("doc_id >= 80").collect()
    assert all(row["kept"] == (row["doc_id"] % 2 == 0) and not row["base_failed"] for row in rows)


def test_quality_sample_is_bounded_for_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_ROWS", 50)
    sampled = []
    monkeypatch.setattr(quality, "fit", lambda packed, good: sampled.append(len(packed)))
    rows = spark.range(2000).selectExpr("7L id", "'word ' || id % 1000 text")
    quality.learn(rows, spark.sql("select 7L id, true good"))
    assert 20 <= sampled[0] <= 90


def test_held_out_rows_follow_crc32(spark):
    rows = spark.range(50).select("id", language.held_out(F.col("id")).alias("held")).collect()
    assert all(row["held"] == (zlib.crc32(str(row["id"]).encode()) % 4 == 2) for row in rows)
