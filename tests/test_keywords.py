import math
import os
import random

import pytest
import regex
from pyspark.sql import functions as F

from akin.operators import keywords, textsearch
from akin.config import PRIME, SearchConfig
from akin.plans import corpus, keyword_quality, quality
from akin.session import CHECKPOINT_DIR, materialise, release, scratch_folder
from akin.sources import articles, crawl, sinks
from tests import fixtures

TEXT = "Spark engines sort data. The Spark engine reads NASA data, and sorts it! data engines"


def features(spark, text):
    docs = spark.createDataFrame([(1, None, text)], "doc_id long, lang string, full_text string")
    return {r["term"]: r for r in keywords.term_features(docs).collect()}


def test_term_counts(spark):
    rows = features(spark, TEXT)
    spark_row, data = rows["spark"], rows["data"]
    assert (spark_row["tf"], spark_row["tf_proper"], spark_row["tf_acronym"]) == (2, 1, 0)
    assert rows["nasa"]["tf_acronym"] == 1
    assert (data["tf"], data["n_sentences"], data["median_sentence"]) == (3, 3, 1.0)
    assert (data["n_left"], data["all_left"], data["n_right"], data["all_right"]) == (2, 2, 1, 1)
    assert not rows["the"]["is_content"]


def test_term_score_by_hand(spark):
    rows = features(spark, TEXT)
    tfs = [r["tf"] for r in rows.values() if r["is_content"]]
    mean = sum(tfs) / len(tfs)
    scale = mean + math.sqrt(sum((t - mean) ** 2 for t in tfs) / len(tfs))
    related = 1 + (2 / 2 + 1 / 1) * 3 / 3
    want = related * math.log(math.log(3 + 1.0)) / (0 + (3 / scale) / related + (3 / 3) / related)
    assert rows["data"]["score"] == pytest.approx(want)


def test_candidates_hold_no_stopword_and_stay_in_a_chunk(spark):
    docs = spark.createDataFrame([(1, "en", TEXT)], "doc_id long, lang string, full_text string")
    found = {r["keyword"] for r in keywords.candidates(docs).collect()}
    assert {"spark engines sort", "nasa data", "data"} <= found
    assert not any(w in keywords.stopwords() for k in found for w in k.split())
    assert "data spark" not in found and "data sorts" not in found and "reads nasa data" in found


def test_stopwords_follow_the_language(spark):
    rows = [(lang, f"The war hat son die. {lang or 'x'} words") for lang in ("en", "de", "fr", "es", "nl", None)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, lang string, full_text string")
    found = keywords.term_features(docs).where("not is_content").collect()
    stopped = {i: {r["term"] for r in found if r["doc_id"] == i} for i in range(len(rows))}
    assert stopped[0] == {"the"}
    assert stopped[1] == {"war", "hat", "die"}
    assert stopped[2] == {"son"}
    assert stopped[4] == stopped[5] == {"the", "war", "hat", "son", "die"}


def test_near_duplicates_are_left_out_but_the_list_is_filled():
    scored = [(0.1, "information systems"), (0.2, "information system"), (0.3, "other"), (0.4, "last")]
    assert [k for _, k in keywords.best_keywords(scored, 2)] == ["information systems", "other"]


def test_bounded_distance_is_the_edit_distance(spark):
    draw = random.Random(5)
    pairs = [["".join(draw.choices("abé ", k=draw.randint(1, 12))) for _ in "ab"] for _ in range(300)]
    rows = spark.createDataFrame([(*p, i) for i, p in enumerate(pairs)], "a string, b string, i int").select("i", F.levenshtein("a", "b").alias("d")).collect()
    distance = {r["i"]: r["d"] for r in rows}
    for i, (a, b) in enumerate(pairs):
        assert [keywords.within(a, b, limit) for limit in range(6)] == [distance[i] <= limit for limit in range(6)]


def test_distance_is_only_taken_where_a_piece_is_shared(monkeypatch):
    rng = random.Random(11)
    pairs = []
    for _ in range(3000):
        a = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 45)))
        b = list(a if rng.random() < 0.8 else a[::-1])
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "bc"])
        pairs.append((a, "".join(b) or "x"))

    def plain(a, b):
        limit = next(n for n in range(99) if 1.0 - (n + 1) / max(len(a), len(b)) <= keywords.DUPLICATE_LIMIT)
        return limit > 0 and keywords.within(a, b, limit)

    assert [keywords.similar(a, b) for a, b in pairs] == [plain(a, b) for a, b in pairs]
    asked = []
    monkeypatch.setattr(keywords, "within", lambda *pair: asked.append(pair))
    assert not keywords.similar("market garden", "winter season") and not asked


def plain_words(text):
    """sentence, chunk, pos and word by splitting."""
    for sentence, body in enumerate(regex.split(keywords.SENTENCE_END, text)):
        for chunk, run in enumerate(regex.split(keywords.CHUNK_END, body)):
            for pos, word in enumerate(w for w in run.split(" ") if w):
                yield sentence, chunk, pos, word


@pytest.mark.parametrize("window", [1 << 20, 3])
def test_tokens_are_what_splitting_gives(monkeypatch, window):
    monkeypatch.setattr(keywords, "WINDOW", window)
    draw = random.Random(7)
    texts = ["".join(draw.choices(["a", "Éb", "NASA", " ", " ", ".", "!?", ",", "--", "\n", "9"], k=draw.randint(0, 40))) for _ in range(200)]
    words = keywords.tokens([None, "", *texts, "", None])
    got = list(zip(words.doc.tolist(), words.sentence.tolist(), words.chunk.tolist(), words.pos.tolist(), strict=True))
    want = [(doc, *place, word) for doc, text in enumerate(texts, 2) for *place, word in plain_words(text)]
    assert got == [w[:4] for w in want]
    assert [words.terms[t] for t in words.term] == [w[4].lower() for w in want]
    assert [bool(c) for c in words.capital] == [w[4][0].isupper() for w in want]
    runs = {}
    for w, line in zip(want, words.line.tolist(), strict=True):
        runs.setdefault(line, set()).add(w[:3])
    assert all(len(places) == 1 for places in runs.values())


def test_texts_without_keywords_keep_their_row(spark):
    rows = [(1, None, ""), (2, "en", "the of and"), (3, "en", None), (4, "en", "..."), (5, "en", "house")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, full_text string")
    found = {r["doc_id"]: r["keywords"] for r in keywords.extract_keywords(docs, 3).collect()}
    assert {i for i, k in found.items() if k is None} == {1, 2, 3, 4}
    assert [k["keyword"] for k in found[5]] == ["house"]


def test_title_search_equals_brute_force(spark):
    texts = {i: t for i, t in fixtures.make_texts(40).items() if t}
    docs = spark.createDataFrame(
        [(i, " ".join(t.split()[:3]).title(), t) for i, t in texts.items()], "doc_id long, title string, text string"
    )
    split = corpus.whole(docs, SearchConfig(), 5)
    rows = keyword_quality.external_top(split, 4).collect()
    words = {i: fixtures.normalise(t).replace("\t", " ").split(" ") for i, t in texts.items()}
    n_docs = len(texts)
    place = {i: p for p, i in enumerate(fixtures.order(texts))}
    idf = lambda w: math.log(n_docs / sum(w in ws for ws in words.values()))
    for q in fixtures.order(texts)[5:]:
        asked = {w for w in " ".join(texts[q].split()[:3]).lower().split() if any(w in ws for ws in words.values())}
        score = {
            d: round(sum(ws.count(w) * idf(w) for w in asked), 9) for d, ws in words.items() if asked & set(ws)
        }
        want = sorted(score, key=lambda d: (-score[d], place[d]))[:4]
        got = sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["doc_id"] for r in got] == want


def test_articles(spark):
    pages = spark.createDataFrame(
        [
            (1, "http://x/en/a?b=1", "<head></head><nav><a href=\"/p\">p</a><a href=\"/q\">q</a>"),
            (2, "x/en/nothing", "<a href=\"/r\">"),
            (3, "http://x/de/c", ""),
            (4, None, ""),
            (5, "http://x/en/d", "body"),
        ],
        "page_id long, url string, html string",
    )
    kinds = articles.kind_counts(pages, "/en/").first()
    assert tuple(kinds) == (5, 2, 1, 2)
    titles = articles.scan_articles(pages, "/en/")
    assert sorted(r["title"] for r in titles.collect()) == ["x/en/a", "x/en/d"]
    assert tuple(articles.coverage(titles, pages).first()) == (2, 1, 1)
    assert [r["page_id"] for r in articles.lookup_content(titles, pages).collect()] == [5]
    assert [tuple(r) for r in articles.index_links(pages).collect()] == [(1, 1, "/p"), (1, 2, "/q")]


def test_crawl_lists_keep_duplicates_and_append(spark, tmp_path):
    frames = [
        spark.createDataFrame(rows, "cid string, ext string")
        for rows in ([("a", ".txt"), ("a", ".txt"), ("b", ".png")], [("c", ".txt")])
    ]
    lists = [crawl.write_crawl_list(f, str(tmp_path / f"list{i}")) for i, f in enumerate(frames)]
    ids = crawl.filter_crawl_ids(crawl.read_crawl_lists(spark, lists), ".txt")
    for _ in range(2):
        crawl.append_ids(ids, str(tmp_path / "ids"))
    back = crawl.read_ids(spark, str(tmp_path / "ids"))
    assert sorted(r["cid"] for r in back.collect()) == ["a"] * 4 + ["c"] * 2
    assert [r["cid"] for r in crawl.scan_limit(back, 3).collect()] == ["a", "a", "a"]


def test_sink_appends_runs(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5)], "n long, x double")
    for run in ("first", "second"):
        sinks.append_rows(rows, str(tmp_path / "t"), run)
    back = sinks.read_rows(spark, str(tmp_path / "t"), rows)
    assert sorted(map(tuple, back.collect())) == [(1, 0.5, "first"), (1, 0.5, "second")]
    assert rows.columns == ["n", "x"]


def test_scratch_folder_is_the_one_of_the_session(spark):
    assert scratch_folder(spark) == spark.conf.get(CHECKPOINT_DIR)
    assert spark.createDataFrame([(1,)], "a int").select(F.col("a")).first()[0] == 1


def test_words_split_at_anything_but_letters_and_digits(spark):
    row = spark.createDataFrame([("Ab-c é1, ",)], "t string").select(textsearch.words(F.col("t"))).first()[0]
    assert row == ["ab", "c", "é1"]


def stop_documents(spark):
    """Forty documents; those of an id divisible by 4 have stopwords only, so their keyword list is empty."""
    words = "apple river stone cloud paper lamp horse green".split()
    rows = []
    for i in range(40):
        text = "and the of to in with for from by that " * 3 if i % 4 == 0 else " ".join(words[(i + j) % 8] for j in range(12))
        rows.append((i, "the", text))
    return spark.createDataFrame(rows, "doc_id long, title string, text string")


def test_documents_without_keywords_stay_in_every_search(spark):
    docs = stop_documents(spark)
    cfg = SearchConfig(num_perm=16)
    signed = {r["doc_id"]: r["kw_5"] for r in keyword_quality.keyword_signatures(docs, (5,), 16).collect()}
    assert set(signed) == set(range(40))
    assert all((signed[i] == [PRIME] * 16) == (i % 4 == 0) for i in signed)
    split = corpus.holdout(docs, cfg)
    table = corpus.signed(split).join(keyword_quality.keyword_signatures(docs, (5,), 16), "doc_id")
    assert table.count() == corpus.signed(split).count() == 40
    by_keyword = corpus.signature_top(table, 3, "kw_5").collect()
    assert len(by_keyword) == len(corpus.signature_top(corpus.signed(split), 3).collect())
    # A query without keywords finds the documents that have none either.
    for r in by_keyword:
        if r["query_id"] % 4 == 0:
            assert r["doc_id"] % 4 == 0 and r["score"] == 1.0


def test_keyword_and_plain_statistics_agree_on_the_plain_searches(spark):
    docs = stop_documents(spark)
    cfg = SearchConfig(num_perm=16, n_keywords=5)
    split = corpus.holdout(docs, cfg)
    plain = {r["query_id"]: (r["n_candidates"], r["overlap_lsh"], r["overlap_sig"]) for r in quality.search_quality(split)[0].collect()}
    both = {r["query_id"]: (r["n_candidates"], r["overlap_lsh"], r["overlap_sig"]) for r in keyword_quality.keyword_quality(split, docs).collect()}
    assert plain == both


def test_released_tables_are_gone(spark):
    table = materialise(spark.range(5), "five")
    folder = table.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("//", "/")
    assert table.count() == 5 and os.path.isdir(folder)
    release(spark)
    assert not os.path.exists(folder)


def test_features_hold_no_object_per_term(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(keywords, "BATCH", 1 << 17)
    texts = [" ".join(f"w{doc}x{i}" for i in range(300)) for doc in range(400)] + ["", None, "the dog"]
    tracemalloc.start()
    found = keywords.feature_lists(pa.nulls(len(texts), pa.string()), pa.array(texts, pa.string()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 120,000 terms; 100 MB as one object each.
    assert peak < 60e6
    assert [len(row) for row in found.to_pylist()] == [300] * 400 + [0, 0, 2]
    assert [(t["term"], t["score"] is None) for t in found[-1].as_py()] == [("the", True), ("dog", False)]
