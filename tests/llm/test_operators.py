"""The operators against plain versions, and on nulls, ties, long texts, empty tables and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilewright.llm import alignment, decontaminate, html_text, mixing, multiset_hash, negatives, quality, rules, sharding, simhash, token_counts, token_output, url_filter

TOKENIZER = "byte_bpe_50k.json"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, idx long, fp string, size string, row string, part string, score string"


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    vocabulary = ["the", "of", "and"] + ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(200)]
    return ". ".join(" ".join(r.choice(vocabulary) for _ in range(9)).capitalize() for _ in range(max(1, words // 9))) + "."


@pytest.fixture(scope="module")
def rows():
    texts = [prose(i, 60 + 7 * i) for i in range(40)]
    texts[5] = texts[4]  # an exact copy
    texts[7] = texts[6].replace(" of ", " off ", 1)  # a near copy
    out = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    out += [(100, None, None, None, None), (101, "", "", "", 0), (102, "   \n\t", "en", "s1", 5), (103, "Ünï cödé “x” 12 km", "de", None, 9)]
    out += [(None, prose(77, 50), "en", "s2", 1), (None, prose(78, 50), "en", "s2", 1)]
    out += [(104, "word " * 30_000, "en", "s3", 1)]  # very long
    out += [(3, texts[3], "en", "s3", len(texts[3]))] * 2  # repeated rows
    return [(*r, "x", 1, "y", "z", "r", "p", "q") for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_url_filter_agrees_with_plain_rules(spark):
    urls = ["http://a.example.com/en/785", "https://EXAMPLE.net/de/8?x", "http://x.org/es/#top", "no url", "", None, "http://free-bets.example.org/fr/1", "http://com/en/", "http://xcom/en/"] * 2
    pages = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, token string")
    rules = [url_filter.host_path_rule(t, v) for t, v in url_filter.CONTRACT_RULES] + [url_filter.pattern_rule(p, "block") for p in url_filter.PATTERNS]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages, rules).collect()}
    want = [
        ("a.example.com", "/en/785", "example.com/en/7", "allow"), ("example.net", "/de/8", "example.net/de/8", "block"), ("x.org", "/es/", "org/es/", "block"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("free-bets.example.org", "/fr/1", "||free-bets.*", "block"),
        ("com", "/en/", "com/en/", "block"), ("xcom", "/en/", None, "allow"),
    ]
    assert [got[i] for i in range(18)] == want * 2
    assert url_filter.judge(pages.limit(0), rules).count() == 0


def test_rules_are_filed_under_their_rarest_token(spark):
    pages = spark.createDataFrame([(f"http://common.example/{i}",) for i in range(9)] + [("http://rare.common.example/1",)], "url string")
    rule = url_filter.pattern_rule("||rare.common.example/^", "block")
    index = url_filter.build_index(pages, F.concat(url_filter.host_of(F.col("url")), url_filter.path_of(F.col("url"))), [rule])
    assert [r["token"] for slot in index for r in slot] == ["rare"]


def test_shares_cap_and_reshare():
    got = mixing.shares({"a": 10, "b": 100, "c": 100, None: 30}, (5, 2, 1))
    assert got["a"] == 30 and sum(got.values()) == pytest.approx(240)
    assert got["b"] / got["c"] == pytest.approx(2) and got[None] == pytest.approx(90)


def test_mixing_hits_targets_and_repeats(docs, none):
    plan = mixing.plan_mix(docs).collect()
    assert sum(r["m"] for r in plan) == docs.count() and all(0 <= r["copies"] <= 3 for r in plan)
    for s in {r["source"] for r in plan}:
        mine = [r for r in plan if r["source"] == s]
        largest = max(r["size"] * r["m"] for r in mine)
        assert abs(sum(r["size"] * r["m"] * r["copies"] for r in mine) - mine[0]["target"]) <= largest
    assert sorted(map(str, plan)) == sorted(map(str, mixing.plan_mix(docs.repartition(5)).collect()))
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r["m"] * r["copies"] for r in plan)
    assert mixing.plan_mix(none).count() == 0 and mixing.mix(none).count() == 0


def test_pivotal_rounding_keeps_sums_and_chances(spark):
    parts = spark.range(3000).select(F.lit("s").alias("stratum"), F.col("id").alias("key"), (F.col("id") % 50 + 1).cast("double").alias("size"), F.lit(0.3).alias("x"))
    got = parts.drop("x").join(mixing.pivotal_round(parts).drop("stratum"), "key").agg(F.sum(F.col("size") * F.col("x")), F.sum("size"), F.avg("x")).first()
    assert abs(got[0] - 0.3 * got[1]) <= 50 and abs(got[2] - 0.3) < 0.02


def test_mixing_plan_against_plain_counts(docs, rows):
    import re

    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + words(r[1])
    target = mixing.shares(sizes, (5, 2, 1))
    plan = mixing.plan_mix(docs).collect()
    got = sorted(str((r["doc_id"], r["source"], r["size"], r["source_size"], round(r["target"], 6))) for r in plan for _ in range(r["m"]))
    assert got == sorted(str((r[0], r[3], words(r[1]), sizes[r[3]], round(target[r[3]], 6))) for r in rows)
    assert all(r["copies"] <= 3 for r in plan)


def test_identical_rows_are_mixed_one_by_one(spark):
    data = [(7, "a", "word " * 10)] * 50 + [(i, "b", "word " * 5) for i in range(100)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string")
    plan = mixing.plan_mix(docs).where("source = 'a'").collect()
    assert sum(r["m"] for r in plan) == 50 and abs(sum(10 * r["m"] * r["copies"] for r in plan) - plan[0]["target"]) <= 10
    assert {r["copies"] for r in plan} == {1, 2}
    mixed = {r["source"]: r["count"] for r in mixing.mix(docs).groupBy("source").count().collect()}
    assert mixed["a"] == sum(r["m"] * r["copies"] for r in plan)


def test_token_files_round_trip(spark, docs, none, rows, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    token_output.write_tokens(docs, str(tmp_path / "t"), TOKENIZER)
    got = token_output.token_digest(spark, str(tmp_path / "t")).collect()
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids + [2]
        want.append((r[0], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(a), b, c) for a, b, c in want)
    got.sort(key=lambda r: (r["start"], r["n_tokens"]))
    assert [r["start"] for r in got] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in got])[:-1]]).tolist()
    ids = [r["doc_id"] for r in got]
    assert ids[:2] == [None, None] and ids[2:] == sorted(ids[2:])
    assert [r["doc_id"] for r in token_output.read_tokens(spark, str(tmp_path / "t"), [101]).collect()] == [101]
    token_output.write_tokens(none, str(tmp_path / "none"), TOKENIZER)
    assert token_output.token_digest(spark, str(tmp_path / "none")).count() == 0


def test_token_lookups_skip_files(spark, tmp_path):
    data = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text number "), F.col("id")).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows make one file
    token_output.write_tokens(data, str(tmp_path / "t"), TOKENIZER)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = token_output.read_tokens(spark, str(tmp_path / "t"), [1234])
    assert [r["doc_id"] for r in found.collect()] == [1234]
    plan = found._jdf.queryExecution().executedPlan()
    read = plan.collectLeaves().head().metrics().get("numOutputRows").get().value()
    files = found.select("part").distinct().count(), token_output.read_tokens(spark, str(tmp_path / "t")).select("part").distinct().count()
    assert files[0] == 1 < files[1] and 0 < read < 2500


def test_encoder_memory_is_bounded():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOKENIZER)
    library, e = Tokenizer.from_file(path), token_output.Encoder(path)
    e.pretokens.free = 3000
    texts = [prose(i, 200) + " it's  12\n½ 😀<|endoftext|> end " for i in range(20)]
    assert [np.frombuffer(b, "<i4").tolist() for b in e.encode(texts)] == [t.ids for t in library.encode_batch(texts, add_special_tokens=False)]
    assert 0 < len(e.pretokens) < 20 and e.pretokens.free >= 0


def test_token_counts_match_the_library(docs, none):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOKENIZER)
    library, counter, encoder, r = Tokenizer.from_file(path), token_counts.Counter(path), token_output.Encoder(path), random.Random(3)
    pieces = ["'", "s", "re", "ll", "'ve", "d", " ", "  ", "\n", "\t", "a", "é", "1", "½", "!", "<|endoftext|>", " ", "的", "😀", "̀", "\x85", "\x1c", "_"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(0, 60))) for _ in range(3000)] + ["x" * 5000, "ab " * 9000]
    ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts).tolist() == list(map(len, ids))
    assert [np.frombuffer(b, "<i4").tolist() for b in encoder.encode(texts)] == ids
    got = token_counts.count_tokens(docs, TOKENIZER).select("text", "n_bytes", "n_tokens", "over_limit").collect()
    for row in got:
        n = len(library.encode(row["text"] or "", add_special_tokens=False).ids)
        assert (row["n_bytes"], row["n_tokens"], row["over_limit"]) == (len((row["text"] or "").encode()), n, n > 512)
    assert token_counts.count_tokens(none, TOKENIZER).count() == 0


def test_token_counts_with_a_small_table(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(TOKENIZER)
    library, counter = Tokenizer.from_file(path), token_counts.Counter(path)
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    monkeypatch.setattr(token_counts, "PASS_CHARS", 900)
    r = random.Random(2)
    texts = [prose(i, 120) for i in range(30)] + ["".join(r.choice("abcxyzé") for _ in range(40_000)), "z" * 150_000]
    assert counter.count(texts).tolist() == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(counter.key) < 20_000


def test_a_full_table_keeps_what_was_met_last(monkeypatch):
    import public_tokenizers

    counter, texts, compiled = token_counts.Counter(public_tokenizers.path(TOKENIZER)), [prose(1, 400)], []
    plain = counter._compile
    monkeypatch.setattr(counter, "_compile", lambda *a: (compiled.append(a), plain(*a)))
    first = counter.count(texts).tolist()
    once = len(compiled)
    monkeypatch.setattr(token_counts, "MAX_STATES", len(counter.key) - 1)
    assert counter.count(texts).tolist() == first
    assert once < len(compiled) < 1.9 * once


def test_chunk_maps_compose_to_a_plain_reading():
    import public_tokenizers
    import regex

    counter = token_counts.Counter(public_tokenizers.path(TOKENIZER))
    text = "It's  a\n\n test 'tis we'll x've  \t 12½ — end   " * 400
    points = np.array([*map(ord, text), 0x110000], np.uint32)
    starts = np.flatnonzero(counter.starts(points)[:-1]).tolist()
    assert starts == [m.start() for m in regex.finditer(token_output.SPLIT, text)]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("", ""),
        (None, ""),
        ("<p>just &amp; text", "just & text"),
        ("<nav><a href=x>menu</a></nav><article><h1>Title</h1><p><b>One,  two<br>three<p>Four &lt;x&gt;</article><footer>f</footer>", "Title\n\nOne, two three\n\nFour <x>"),
        ("<body><div class='sidebar'>side bar words, many, many</div><div id=c><p>Long text, with commas, here.</p><p>Second</p></div><div id=comments><p>great, post, wow, yes</p></div>",
         "Long text, with commas, here.\n\nSecond"),
        ("<main><form>name <input></form><p>A<script>var p='</p>';</script>B</p><div class=ad>buy</div></main>", "AB"),
        ("<article>" + "<div>" * 3000 + "deep text" + "</div>" * 10, "deep text"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page or "") == text


LONG = "Long text, with commas, here and there. " * 8


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<![foo[bar]]><p>a b</p><![ foo><p>c", "a b\n\nc"),
        (f'<div class="site-content no-sidebar"><p>{LONG}</p></div>', LONG.strip()),
        (f'<div class="post search-result-page"><h1>T</h1><p>{LONG}</p></div><div class=search-box>x</div>', f"T\n\n{LONG.strip()}"),
        (f"<article><p>{LONG}</p></article><!-- open <p>no</p>", LONG.strip()),
        (f"<article><h1>Head</h1><div><p>lead</p></div><div class=body>{f'<p>{LONG}</p>' * 20}</div><section>short end</section></article>",
         "\n\n".join(["Head", "lead", *[LONG.strip()] * 20, "short end"])),
        (f"<article><p>{LONG}</p><ul><li><a href=x>one</a><li><a href=y>two</a></ul><p>end</p></article>", f"{LONG.strip()}\n\none\n\ntwo\n\nend"),
        (f"<body><ul><li><a href=x>one</a><li><a href=y>two</a></ul><p>{LONG}</p><p>end of it</p></body>", f"{LONG.strip()}\n\nend of it"),
        (f'<body><div id=x><p>{LONG}</p></div><div class="comments-area">{f"<p>{LONG}</p>" * 5}</div></body>', LONG.strip()),
        (f"<body><h1>Title</h1><div><p>{LONG}</p><p>{LONG}</p></div><div class=ad>x</div></body>", f"Title\n\n{LONG.strip()}\n\n{LONG.strip()}"),
        (f'<p>{LONG}</p><div class="x', LONG.strip()),
        ("<p>x<![CDATA[ y ]]>z</p><?pi?><!-->", "xz"),
    ],
)
def test_articles_are_whole(page, text):
    assert html_text.main_text(page) == text


def test_odd_pages_take_linear_time():
    import time

    began = time.process_time()
    for page in ("<b>" * 8000 + "</i>" * 8000, "<b>" * 50_000 + "x", "<i><p>" + "<b>" * 8000 + "</i>" * 8000, "<div>" * 8000 + "<li><dt>" * 8000, "<b>" * 8000 + "<hr>" * 8000, "<![CDATA[" * 8000):
        html_text.main_text(page)
    assert html_text.main_text(f"<article><p>{'word, ' * 400_000}</article>") == ("word, " * 400_000).strip()
    assert time.process_time() - began < 8


def plain_page(r: random.Random) -> tuple[str, str]:
    """A page made of an article and what stands around it, with the article's text."""
    part = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 8))) for _ in range(n)) + ", or &amp; so."
    blocks, tags = [], []
    for _ in range(r.randint(1, 12)):
        text = part(r.randint(3, 60))
        tag = r.choice(["p", "p", "p", "blockquote", "pre", "h2"])
        tags.append(f"<{tag}>" + text.replace(" ", r.choice([" ", "\n  "])) + (f"</{tag}>" if tag != "p" or r.random() < 0.7 else ""))
        blocks.append(text.replace("&amp;", "&"))
    links = "".join(f"<li><a href=/{i}>{part(2)}</a>" for i in range(6))
    noise = [f"<nav><ul>{links}</ul></nav>", f"<div class=ad>{part(9)}</div>", f"<aside>{part(30)}</aside>", f"<form>{part(5)}<input></form>", f"<div id=comments><p>{part(60)}</p></div>", f"<script>{part(4)}</script>", "<!-- x -->"]
    r.shuffle(noise)
    inside = r.sample(noise, 2)
    body = "".join(tags[:1]) + inside[0] + "".join(tags[1:]) + inside[1]
    return f"<html><head><title>{part(3)}</title></head><body>{noise[0]}<header>{part(4)}</header><article>{body}</article>{noise[1]}<footer>{part(9)}</footer></body></html>", "\n\n".join(blocks)


def test_pages_against_their_makers():
    r = random.Random(8)
    for _ in range(300):
        page, text = plain_page(r)
        assert html_text.main_text(page) == text


def test_pages_keep_their_rows(spark):
    pages = spark.createDataFrame([(1, "u", "<p>a b</p>", "old"), (1, "u", "<p>a b</p>", "old"), (2, None, None, "old")], "page_id long, url string, html string, text string")
    assert sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_pages(pages).collect()) == [(1, "a b", 3), (1, "a b", 3), (2, "", 0)]
    assert html_text.extract_pages(pages.limit(0)).count() == 0


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    w = (text or "").encode().lower().split()
    s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash_components(docs, none, rows):
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.simhash_components(docs).collect()]
    prints = [plain_fingerprint(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[root[i]] = min(least.get(root[i], r[0]), r[0])
    want = [(r[0], f"{prints[i]:016x}", least.get(root[i])) for i, r in enumerate(rows)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert simhash.simhash_components(none).count() == 0


def test_bucket_forests_span_all_links():
    r = np.random.default_rng(1)
    base = r.integers(0, 2**63, 40, dtype=np.uint64)
    words = np.concatenate([base ^ (np.uint64(1) << np.uint64(k)) for k in range(6)])[:, None]
    links = simhash._forest(words, 3)
    assert len(links) == len(words) - 40 and all((int(words[a, 0]) ^ int(words[b, 0])).bit_count() <= 3 for a, b in links)


def test_near_duplicates_leave_one_of_each_group(docs, none, rows):
    kept = simhash.drop_near_duplicates(docs)
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert kept.columns == docs.columns and len(ids) == len(rows) - 2 - 4  # repeated rows, one of 4/5 and of 6/7, two of 100/101/102
    assert 4 in ids and 5 not in ids and 6 in ids and 7 not in ids and ids.count(3) == 1
    assert simhash.drop_near_duplicates(none).count() == 0


def near_groups_of(texts: list[str]) -> set[frozenset[int]]:
    """Groups of two and more by brute force over all pairs."""
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared) and root[i] != root[j]:
                root = [root[i] if r == root[j] else r for r in root]
    return {g for r in set(root) if len(g := frozenset(i for i, x in enumerate(root) if x == r)) > 1}


def near_left(spark, texts: list[str]) -> list[int]:
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    return sorted(r["doc_id"] for r in simhash.drop_near_duplicates(data).collect())


def near_want(texts: list[str]) -> list[int]:
    gone = {i for g in near_groups_of(texts) for i in g if i != min(g)}
    return [i for i in range(len(texts)) if i not in gone]


def test_near_candidates_miss_no_pair(spark):
    r, texts = random.Random(3), []
    for k in range(30):
        w = prose(500 + k, 120 + 10 * k).split()
        n = len(w)
        new = lambda m: [f"new{r.randrange(10**6)}" for _ in range(m)]
        texts += [" ".join(w), " ".join(w[: n - n // 6]), " ".join(w + new(n // 5)), " ".join(new(n // 6) + w)]
        for share in (0.015, 0.02, 0.03):
            texts.append(" ".join(x if r.random() > share else new(1)[0] for x in w))
    want = near_want(texts)
    assert len(want) < len(texts) - 60 and near_left(spark, texts) == want


def test_near_links_in_large_buckets(spark):
    r, texts = random.Random(4), []
    words = [f"w{i}" for i in range(100)]
    head = " ".join(f"head{i}" for i in range(60))
    for k in range(2 * simhash.FEW):
        mixed = r.sample(words, 100)  # one set of words, so one fingerprint, in orders of their own
        texts += [" ".join(mixed), " ".join(mixed[:-2] + mixed[:-3:-1])]
        own = head + " " + " ".join(f"own{k}x{i}" for i in range(60))  # a head that many unlike texts share
        texts += [own, own + " end"]
        texts.append(" ".join(f"copy{i}" if i != k else "edit" for i in range(120)))  # a large group of near copies
    want = near_want(texts)
    assert len(want) == 4 * simhash.FEW + 1 and near_left(spark, texts) == want


def test_near_similarity_is_exact_for_long_texts(spark):
    texts = []
    for m in range(100, 122):
        w = prose(700 + m, 1000).split()
        texts += [" ".join(w), " ".join(w[:-m] + [f"other{i}" for i in range(m)])]
    want = near_want(texts)
    assert len(texts) // 2 < len(want) < len(texts) and near_left(spark, texts) == want


def test_edit_report(docs, none, rows):
    got = sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in multiset_hash.edit_report(docs).collect())
    signed = {t: r for t, r in docs.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).distinct().collect()}
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is None, -(r[0] or 0), signed[r[1]]))
    want = []
    for i, (doc, text) in enumerate(order):
        after, k = order[(i + 1) % len(order)][1], len(text) // 3
        want.append((str(doc), len(text), hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()))
    assert got == sorted(want)
    assert multiset_hash.edit_report(none).count() == 0


def test_multiset_hash_is_homomorphic(spark):
    a, b = "One two. Three.\nFour five", "Six seven\nEight"
    df = spark.createDataFrame([(0, a), (1, b), (2, f"{a}\n{b}"), (3, f"{b}\n\n{a}"), (4, "Other words. Entirely.")], "id long, t string")
    fp = multiset_hash.fingerprints(df, ["id"], ["t"])
    one = {r["id"]: r["fp"] for r in fp.collect()}
    assert one[2] == one[3] != one[0]
    pair = spark.createDataFrame([(one[0], one[1], one[2], one[4])], "a array<bigint>, b array<bigint>, c array<bigint>, d array<bigint>")
    a, b, c, d = (F.col(x) for x in "abcd")
    got = pair.select(multiset_hash.add(a, b), multiset_hash.subtract(c, b), multiset_hash.likeness(c, c), multiset_hash.likeness(a, c), multiset_hash.likeness(a, d)).first()
    assert list(got[0]) == list(one[2]) and list(got[1]) == list(one[0]) and got[2] == 1.0 and got[3] > 0.4 > got[4]


def plain_multiset(text: str) -> tuple[np.ndarray, int]:
    """Lane sums and number of units, one unit after the other."""
    import re

    from xxhash import xxh64_intdigest

    units = ["p" + p.strip(" ") for p in text.split("\n") if p.strip(" ")]
    sentences = [x.strip(" ") for x in re.split(r"\n|(?<=[.!?])[ \t]+", text) if x.strip(" ")]
    units += ["s" + x for x in sentences]
    for x in sentences:  # words of at most 64 letters, eight to a piece, with the blanks behind them
        words = re.findall(r"[^ \t\x0B\f\r]{1,64}[ \t\x0B\f\r]*", x)
        units += ["c" + "".join(words[i : i + 8]).strip(" ") for i in range(0, len(words), 8)] if len(words) > 8 else []
    lanes = np.zeros(multiset_hash.LANES, np.int64)
    for u in units:
        for k in range(multiset_hash.HASHES):
            h = xxh64_intdigest(k.to_bytes(4, "little"), seed=xxh64_intdigest(u.encode(), seed=42))
            lanes[16 * k : 16 * k + 16] += [h >> 4 * i & 15 for i in range(16)]
    return lanes, len(units)


def plain_likeness(a: str, b: str) -> float:
    (x, n), (y, m) = plain_multiset(a), plain_multiset(b)
    if n == m and (x == y).all():
        return 1.0
    x, y = 2 * x - 15 * n, 2 * y - 15 * m
    return float(min(1, max(0, (x @ y) / max(1e-9, np.sqrt(float(x @ x) * float(y @ y))))))


def test_edit_report_against_plain_sums(spark):
    texts = {i: prose(i, 40 + 9 * i) for i in range(30)} | {40: None, 41: "", 42: "no end\nat all", 43: prose(9, 121), 44: "x" * 3000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in multiset_hash.edit_report(docs).collect()}
    order, codes = sorted(texts, reverse=True), {}
    for i, doc in enumerate(order):
        text, after = texts[doc] or "", texts[order[(i + 1) % len(order)]] or ""
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        assert got[doc]["near_edited"] == pytest.approx(plain_likeness(text, edited), abs=1e-9)
        assert got[doc]["near_next"] == pytest.approx(plain_likeness(text, after), abs=1e-9)
        key = tuple(plain_multiset(text)[0])
        assert codes.setdefault(got[doc]["fingerprint"], key) == key and (got[doc]["edited_fingerprint"] == got[doc]["fingerprint"]) == (plain_likeness(text, edited) == 1.0)
    assert got[40]["fingerprint"] == got[41]["fingerprint"] and got[41]["near_next"] == 1.0 and len(codes) == len(set(codes.values()))


def test_quality_model_finds_junk(spark, none):
    junk = ["### ".join(prose(i, 40).split()) for i in range(60)] + [prose(i, 40).upper().replace(" ", "!! ") for i in range(60)] + ["same " * 50] * 30
    good = [prose(1000 + i, 80) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(junk + good + [None, ""])], "doc_id long, text string")
    got = {r["doc_id"]: r["keep"] for r in quality.classify(docs).collect()}
    assert sum(got[i] for i in range(150)) <= 3 and sum(got[i] for i in range(150, 550)) >= 397 and not got[550] and not got[551]
    assert quality.classify(none).count() == 0


@pytest.mark.parametrize("share", [0.4, 0.6])
def test_quality_rejects_a_large_junk_source(share):
    junk = [" ### ".join(prose(i, 20).split()) for i in range(int(300 * share))]
    good = [prose(3000 + i, 60) for i in range(300 - len(junk))]
    votes = np.array([quality.votes_of(t) for t in junk + good])
    patterns, at, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = quality.fit_label_model(patterns, counts.astype(float), list(quality.LABELLERS)).posterior(patterns)[at.ravel()]
    assert (p[: len(junk)] < 0.5).mean() > 0.97 and (p[len(junk) :] >= 0.5).mean() > 0.97


def test_label_model_learns_accuracies():
    r = np.random.default_rng(5)
    kind = r.choice(3, 20_000, p=[0.85, 0.1, 0.05])  # good, and the kinds that the first two labellers are after
    bad = np.stack([r.random(20_000) < np.choose(kind, p) for p in ([0.002, 0.95, 0.1], [0.001, 0.05, 0.9], [0.003, 0.5, 0.5])], axis=1)
    patterns, at, counts = np.unique(1 - bad.astype(int), axis=0, return_inverse=True, return_counts=True)
    model = quality.fit_label_model(patterns, counts.astype(float), ["a", "b", "c"])
    assert ((model.posterior(patterns)[at.ravel()] >= 0.5) == (kind == 0)).mean() > 0.97
    accuracy = model.accuracy()
    assert accuracy["a"][0] > 0.99 and accuracy["a"][1] > 0.85 and accuracy["b"][1] > 0.8


def test_quality_against_labels(spark):
    sf = "/root/testdata/sf0.01"
    both = quality.op8_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("quality", "keep").collect()
    assert len(both) > 100 and sum(r["keep"] == bool(r["quality"]) for r in both) >= 0.99 * len(both)


def test_quality_of_odd_rows(spark, docs, rows):
    got = quality.classify(docs.select("doc_id", "text", "score", "h"))
    assert got.columns == ["doc_id", "score", "keep"] and got.count() == len(rows)
    same = got.where("doc_id = 3").select("score").distinct()
    assert same.count() == 1 and got.where("doc_id is null").count() == 2 and got.where("doc_id = 104").count() == 1


def test_contamination_and_slots(spark, docs, none):
    item = "If Anna buys 12 apples and 7 pears for 3 km of road then how much will Anna pay in the end"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string")
    found = [
        (1, "x y. if Bert buys 45 apples and 9 pears for 8 km of road then how much will Bert pay in the end ok"),
        (2, prose(5, 80) + " " + item), (2, prose(5, 80) + " " + item), (3, None), (4, ""), (5, prose(6, 90)), (None, "A " + item.upper()),
        (6, item.replace("12", "5").replace("7 pears", "5 pears").replace("Anna pay", "Carl pay")),
    ]
    data = spark.createDataFrame(found, "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["item_id"], r["matched"] == r["windows"]) for r in decontaminate.contaminated(data, bench).collect())
    assert [g for g in got if g[2]] == [("1", 1, True), ("2", 1, True)]  # the same values in every slot
    assert ("5", 1) not in {g[:2] for g in got}
    assert decontaminate.drop_contaminated(docs, bench).count() == docs.count()
    assert decontaminate.contaminated(none, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def held_items(spark, items: list[str], texts: list[str]) -> set[tuple[int, int]]:
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(data, bench).collect()}


def test_slots_are_judged_by_place(spark):
    item = "If Anna buys 12 apples and 7 pears for 3 km of road then how much will Anna pay in the end"
    one = item.replace("12", "45").replace("7 pears", "2 pears").replace("3 km", "6 km")
    two = item.replace("12", "31").replace("7 pears", "8 pears").replace("3 km", "4 km")
    texts = [f"{one}. {two}", f"{item}. {one}", item.replace("12", "5").replace("7 pears", "5 pears"), prose(5, 90)]
    dense = "mix {} cups flour with {} cups sugar then {} spoons salt over {} spoons oil near {} bowls milk under {} bowls cream"
    mixed = dense.format(91, 12, 93, 14, 95, 16) + ". " + dense.format(21, 82, 23, 84, 25, 86)  # ties go to either copy by turns
    assert held_items(spark, [item, dense.format(1, 2, 3, 4, 5, 6)], [*texts, mixed]) == {(0, 0), (1, 0), (2, 0), (4, 1)}


def test_short_items_and_long_runs(spark):
    long = " ".join(f"word{chr(97 + i // 8)}{chr(97 + i % 8)}" for i in range(60))
    items = ["What is 12 + 7 - 3?", "Name the largest moon of Saturn", "1 2 3 4 5 plus 6 7 8 9", long, "?"]
    texts = [
        "so: what is 12 + 7 - 3? easy", "What is 12 + 7 - 4?", "Name the largest moon of Saturn, please", "the sum 1 2 3 4 5 plus 6 7 8 9 is",
        " ".join(long.split()[10:40]), " ".join(long.split()[10:25]), prose(5, 90),
    ]
    assert held_items(spark, items, texts) == {(0, 0), (2, 1), (3, 2), (4, 3)}


def test_contamination_against_plain_windows(spark):
    r = random.Random(12)
    words = [f"{a}{b}" for a in "bcdfgh" for b in ("ab", "em", "il", "ox", "ur")]
    items = [[r.choice(words) for _ in range(r.randint(9, 70))] for _ in range(12)]
    texts = []
    for _ in range(120):
        item = r.choice(items)
        at, size = r.randrange(len(item)), r.randint(4, 40)
        texts.append([r.choice(words) for _ in range(r.randint(0, 30))] + item[at : at + size] + [r.choice(words) for _ in range(r.randint(0, 30))])
    want = set()
    for d, text in enumerate(texts):
        places: dict = {}
        for i, w in enumerate(zip(*(text[k:] for k in range(8)), strict=False)):
            places.setdefault(w, []).append(i)
        for n, item in enumerate(items):
            windows = list(zip(*(item[k:] for k in range(8)), strict=False))
            held = [places.get(w, []) for w in windows]
            run = max((sum(1 for _ in g) for by in {p - i for i, ps in enumerate(held) for p in ps} for k, g in __import__("itertools").groupby(by + i in ps for i, ps in enumerate(held)) if k), default=0)
            if 2 * sum(map(bool, held)) >= len(windows) or run >= 16:
                want.add((d, n))
    assert len(want) > 20 and held_items(spark, [" ".join(i) for i in items], [" ".join(t) for t in texts]) == want


def test_no_group_of_copies_below_a_unit_is_split(spark):
    r = random.Random(6)
    texts = [prose(r.randrange(300), 40) for _ in range(1500)] + [prose(5000 + i, 20 + i % 60) for i in range(1500)]
    data = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    placed = sharding.shard_documents(data, 8)
    got = placed.collect()
    load = [sum(x["size"] for x in got if x["shard"] == s) for s in range(8)]
    where: dict = {}
    for x in got:
        where.setdefault(texts[x["doc_id"]], set()).add(x["shard"])
        assert x["size"] == len(texts[x["doc_id"]].encode()) + 8 and x["text_crc32"] == zlib.crc32(texts[x["doc_id"]].encode())
    assert all(len(w) == 1 for w in where.values()) and max(load) - min(load) < 0.01 * sum(load) / 8
    links = sum(texts.count(t) - 1 for t in set(texts))
    assert tuple(sharding.cut_links(placed, data).first()) == (links, 0)


def test_shards_are_even_gapless_and_keep_copies(spark, docs, none):
    texts = [(i, prose(i, 30 + i % 50)) for i in range(900)] + [(2000 + i, prose(9999, 40)) for i in range(20)]
    data = spark.createDataFrame(texts, "doc_id long, text string")
    got = sharding.shard_documents(data, 8).collect()
    load = {s: sum(r["size"] for r in got if r["shard"] == s) for s in range(8)}
    assert len(got) == 920 and max(load.values()) - min(load.values()) < 0.05 * sum(load.values()) / 8
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert len({r["shard"] for r in got if r["doc_id"] >= 2000}) == 1
    assert sharding.shard_documents(docs, 24).count() == docs.count() and sharding.shard_documents(none, 24).count() == 0


def test_pipeline_stages_on_odd_rows(spark, docs, none, tmp_path):
    import corpus_pipeline

    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for start in (docs, none):
        df = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, str(tmp_path))
            assert df.columns == start.columns
        assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    import corpus_pipeline
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    _, stages = zip(*corpus_pipeline.STAGES, strict=True)
    first = stages[0](spark, docs, sf)
    good = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = first.select("doc_id", "text").orderBy("doc_id").collect()
    ids = {r["doc_id"] for r in kept}
    assert sum((d in ids) == bool(q) for d, q in good.items()) >= 0.97 * len(good)
    second = stages[1](spark, first, sf)
    want = near_want([r["text"] for r in kept])
    assert sorted(r["doc_id"] for r in second.select("doc_id").collect()) == [kept[i]["doc_id"] for i in want]
    third = stages[2](spark, second, sf)
    whole = [" ".join(r["text"].lower().split()) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r["doc_id"]: r["text"] for r in second.collect()}
    left = {r["doc_id"] for r in third.select("doc_id").collect()}
    assert not any(b in " ".join((texts[d] or "").lower().split()) for d in left for b in whole) and len(left) >= 0.9 * len(texts)
    fourth = stages[3](spark, third, sf)
    words = lambda t: len((t or "").encode().split())
    before, after = third.select("doc_id", "source", "text").collect(), fourth.select("doc_id", "source", "text").collect()
    sizes, taken, copies = Counter(), Counter(), Counter(r["doc_id"] for r in after)
    for rows, count in ((before, sizes), (after, taken)):
        for r in rows:
            count[r["source"]] += words(r["text"])
    target = mixing.shares(dict(sizes), (5, 2, 1))
    largest = {s: max(words(r["text"]) for r in before if r["source"] == s) for s in sizes}
    assert max(copies.values()) <= 3 and copies.keys() <= {r["doc_id"] for r in before} and all(abs(taken[s] - target[s]) <= largest[s] for s in sizes)
    library = Tokenizer.from_file(public_tokenizers.path(TOKENIZER))
    coded = []
    for r in fourth.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        coded.append((r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = stages[4](spark, fourth, sf).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(coded)
    assert corpus_pipeline.run(spark, sf).count() == len(got)


def plain_measures(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:], strict=False))
    found = Counter(windows)
    covered = {i + d for i, w in enumerate(windows) if found[w] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), sum(map(text.count, rules.SYMBOLS)), len(lines) - len(set(lines)), len(covered)


def test_rules_against_plain_counts(spark, docs, none, rows):
    r = random.Random(3)
    odd = ["a b c a b c", "a a a a", " a\x0bb\x0cc\r\na", "x\n\n x\nx\n x \n", "# # #|<>&%$*", " ".join(r.choice("abcd") for _ in range(500)), "￾ \U0001f600 é"]
    more = spark.createDataFrame([(200 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    for table in (docs.select("doc_id", "text", F.col("h").alias("n_words"), F.col("row").alias("__text")), more):
        got = rules.judged(table)
        assert got.columns[:2] == ["doc_id", "text"] and len(set(got.columns)) == len(got.columns)
        for x in got.collect():
            want = plain_measures(x["text"])
            assert tuple(x[n] for n in names) == want, x["text"]
            assert x["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (x["base_failed"] and x["kept"]) and (x["base_failed"] or x["kept"] == (not x["broken"]))
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert rules.judged(none).count() == 0


def test_repeated_windows_without_room_for_places(spark):
    """Few bits for places: hashes of different windows meet, or the text is too long; both are sorted as text."""
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefg") for _ in range(n)) for n in (2, 3, 4, 60, 300)]
    df = spark.createDataFrame([(t.split(" "), plain_measures(t)[4]) for t in texts], "w array<string>, want long")
    for bits in (24, 62, 5):
        assert all(x["n"] == x["want"] for x in rules.with_repeated_words(df, "w", "n", bits).collect()), bits


def test_thresholds_are_exact(spark):
    rule = rules.Rule("r", "a", "b", (1, 10), (1, 3))
    df = spark.createDataFrame([(a, b) for b in range(31) for a in range(31)], "a long, b long")
    assert all(x["ok"] == (x["b"] == 0 or x["b"] <= 10 * x["a"] and 3 * x["a"] <= x["b"]) for x in df.withColumn("ok", rules.compile_rules([rule])).collect())


def test_rules_keep_good_documents(spark):
    d = "/root/testdata/sf0.01"
    got = rules.judged(spark.read.parquet(f"{d}/documents.parquet")).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id")
    assert got.where("quality = 1 and not base_failed and not kept").count() == 0
    assert got.where("quality = 0 and kept").count() == 0


def plain_alignment(texts: list) -> list[tuple]:
    """The contract read literally: whole texts, all links one by one."""
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    ta = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ta.encode_special_tokens = True
    tb = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    codes = {c: b for c, b in token_output.byte_symbols().items()}
    docs, held = [], Counter()
    for text in texts:
        want = f" {text}".encode() if text else b""
        a = ta.encode(f" {text}", add_special_tokens=False) if text else None
        ids_b = tb.encode(text) if text else []
        raw_a = [bytes(codes[c] for c in t) for t in a.tokens] if text else []
        pieces = [tb.id_to_piece(i) for i in ids_b]
        raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("\u2581", " ").encode() for p in pieces]
        if not text or b"".join(raw_a) != want or b"".join(raw_b) != want:
            docs.append(([], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]), np.cumsum([len(x) for x in raw_b])
        common = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        group = lambda ends: [sum(c < e for c in common) for e in ends.tolist()]
        ga, gb = group(ends_a), group(ends_b)
        groups = [([i for i, x in zip(a.ids, ga, strict=True) if x == g], [i for i, x in zip(ids_b, gb, strict=True) if x == g]) for g in range(len(common))]
        docs.append((a.ids, ids_b, groups))
        held.update({(x, y) for xs, ys in groups for x in xs for y in ys})
    most: dict = {}
    for (x, _), n in held.items():
        most[x] = max(n, most.get(x, 0))
    out = []
    for a, b, groups in docs:
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


ODD_TEXTS = [
    None, "", " ", "  ", "a", " a", "a ", "a  b   c", "a\n b \n\n c\n", "tab\tx \t y", "can't we'll I'M", "<|endoftext|> x<s></s> <unk>", "x\u2581y", "\u2581",
    "\u00a0x \u2003 y\u3000", "naïve café e\u0301 ﬁ", "\U0001f600 \U0001f468\u200d\U0001f469 x", "漢字かな交じり文 です", "\x00a \x1c b\x85c", "1234567 890,12", "a" * 700, "z9" * 300 + " end", "\ufeff \u180e x\u200b y",
    "<0x41> <0x0A>",
]


@pytest.mark.parametrize("memory", [alignment.MEMORY, 1000])
@pytest.mark.parametrize("hot", [alignment.HOT_PAIRS, 30])
def test_alignment_against_plain_links(spark, rows, monkeypatch, hot, memory):
    import public_tokenizers

    if (hot == 30) == (memory == 1000):
        monkeypatch.setattr(alignment, "MEMORY", memory)
        monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
        texts = [*ODD_TEXTS, *[r[1] for r in rows[:12]], rows[0][1], "Größe " * 30]
        df = spark.createDataFrame([(i, t, i, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_a long, row string").repartition(3)
        out = alignment.align_corpus(df, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
        assert out.columns == ["doc_id", "row", *alignment.NUMBERS, "n_best", "count_sum", "groups_sha256"]
        got = {r["doc_id"]: tuple(r)[2:] for r in out.collect()}
        for i, want in enumerate(plain_alignment(texts)):
            assert got[i] == want, texts[i]
        assert alignment.align_corpus(df.limit(0), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")).count() == 0


def test_alignment_of_random_texts():
    """Segments stand for themselves: groups of a text cut into segments are those of the whole text."""
    import public_tokenizers

    aligner = alignment.Aligner(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    r = random.Random(1)
    alphabet = [" ", " ", "  ", "\n", "\t", "\u00a0", "\u2028", "\x1f", "'s", "don't", "the", "ing", "é", "e\u0301", "1", "23", "!", "...", "\u2581", "漢", "\U0001f600", "<s>", "\u200b", "A", "Zq"]
    for n in range(400):
        text = "".join(r.choice(alphabet) for _ in range(r.randint(1, 40)))
        if n % 3:
            text = text.replace("\u2581", "")
        got = aligner.batch([text])
        groups = alignment.groups_of(aligner, text)
        written = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        assert got["groups_sha256"][0] == (hashlib.sha256(written.encode()).hexdigest() if groups else ""), repr(text)
        assert got["n_links"][0] == sum(len(x) * len(y) for x, y in groups)


def plain_negatives(rows: list[tuple]) -> Counter:
    """The contract read literally over (vec_id, embedding, label); the order of rows breaks what ties are left."""
    taken = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        taken.append((i, [math.floor(256 * float(x)) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out: Counter = Counter()
    last = lambda i: 2**63 if i is None else i
    for n, (anchor, q, label) in enumerate(taken):
        if anchor is None or anchor % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(q, v, strict=False)), last(i), i, lab) for m, (i, v, lab) in enumerate(taken) if m != n]
        scored.sort(key=lambda t: t[:2])
        for ps, _, pid, _ in [t for t in scored if t[3] == label][:5]:
            inside = [t for t in scored if t[3] != label and 80 * -ps <= 100 * -t[0] <= 100 * -ps]
            for rank, (ns, _, nid, _) in enumerate(inside[:5], 1):
                out[anchor, pid, rank, nid, -ps, -ns] += 1
    return out


@pytest.mark.parametrize(("block", "chunk", "scale"), [(64, 3, 1.0), (4096, 20_000, 1.0), (50, 4, 30000.0)])
def test_negatives_against_all_pairs(spark, monkeypatch, block, chunk, scale):
    r = np.random.default_rng(4)
    vectors = (r.normal(0, 0.2, (700, 9)) + r.normal(0, 0.3, (4, 9))[r.integers(0, 4, 700)]) * scale
    vectors[300:380] = vectors[300]  # copies, which tie
    rows = [(int(i), [float(x) for x in v.astype(np.float32)], int(r.integers(0, 10))) for i, v in enumerate(vectors)]
    rows += [(700, None, 1), (800, [1.0, None], 1), (900, [float("nan")] * 9, 2), (1000, [float("inf")] * 9, 2), (1100, [0.5] * 9, None), (None, rows[300][1], 3), (None, None, None)]
    rows += [(1200, [], 4), (1300, [0.5, 0.25], 5), (1400, [0.25] * 12, 5), rows[100], rows[200]]
    monkeypatch.setattr(negatives, "BLOCK", block)
    df = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, row string, n int").repartition(5)
    got = negatives.mine(negatives.quantised(df), chunk=chunk)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(tuple(x) for x in got.collect()) == plain_negatives(rows)
    assert negatives.mine(negatives.quantised(df.limit(0))).count() == 0
    assert negatives.mine(negatives.quantised(df.where("vec_id = 3"))).count() == 0


def test_negative_bounds_drop_candidates_early():
    """The scan reads fewer columns of candidates whose bounds leave the window, and its scores are exact."""
    r = np.random.default_rng(2)
    columns = np.floor(r.normal(0, 5, (64, 500))).astype(np.float64)
    block = negatives.Block(columns, np.arange(500), np.arange(500), np.zeros(500, np.int64))
    q = columns[:, 7] * np.geomspace(8, 0.01, 64)
    want = q @ columns
    for low, high in [(-np.inf, np.inf), (np.quantile(want, 0.99), np.inf), (0, np.quantile(want, 0.6)), (want.max() + 1, np.inf)]:
        left, score = block.scan(q, np.arange(500) % 3 > 0, low, high)
        assert left.tolist() == [i for i in range(500) if i % 3 and low <= want[i] <= high]
        assert np.allclose(score, want[left])


def test_mixing_takes_any_column_names(spark):
    names = ["m", "h", "size", "source_size", "target", "copies", "whole", "x", "extra", "key", "stratum", "group", "e", "rate", "s", "__copies", "__m", "__dh", "__row", "___h"]
    rows = [(i, prose(i, 40), f"s{i % 2}", *[f"{c}{i}" for c in names]) for i in range(12)] + [(3, prose(3, 40), "s1", *[f"{c}3" for c in names])]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "source string", *[f"`{c}` string" for c in names]]))
    got = mixing.mix(df)
    assert got.columns == df.columns
    assert {tuple(r) for r in got.collect()} <= set(rows) and got.count() > 0


def test_contaminated_texts_are_read_by_key(spark, monkeypatch):
    """Only the texts of documents with a matched slot move, and the plan without a broadcast gives the same."""
    item = "A farmer in Dover sold 25 apples and 17 pears at the market for 3 dollars each before the rain began to fall on the old town"
    variant = item.replace("25", "31").replace("17", "12")
    texts = [item, variant, variant.replace("12", "99 red") , prose(1, 80), None, "word " * 20_000 + variant, variant]
    docs = spark.createDataFrame([(i % 6, t) for i, t in enumerate(texts)] + [(1, variant)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    found = []
    for keys in (decontaminate.BROADCAST_KEYS, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_KEYS", keys)
        found.append(sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()))
    assert found[0] == found[1] and {0, 1, 5} <= {d for d, _ in found[0]} and 3 not in {d for d, _ in found[0]}


@pytest.mark.parametrize(
    ("body", "text"),
    [
        ("<h1>Title</h1><p>Short intro of the page.</p><div><p>{0}</p><p>{1}</p></div><p>Short end.</p>", ["Title", "Short intro of the page.", "{0}", "{1}", "Short end."]),
        ("<section><h2>One</h2><p>{0}</p><p>{1}</p></section><section><h2>Two</h2><p>Brief.</p></section>", ["One", "{0}", "{1}", "Two", "Brief."]),
        ("<article><header><h1>T</h1><p>Lead of it.</p></header><p>{0}</p></article>", ["T", "Lead of it.", "{0}"]),
        ("<article><h1>T</h1><p>{0}</p><p class='related work'>Earlier papers.</p><p class='ad'>Buy.</p></article>", ["T", "{0}", "Earlier papers."]),
        ("loose words<div><p>{0}</p><p>{1}</p></div>last <b>words</b><h2>Alone</h2>", ["loose words", "{0}", "{1}", "last words", "Alone"]),
        ("<header><h1>Site</h1></header><div><p>{0}</p></div><h3>More</h3><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul><div>\u00a9 2020 Site</div>", ["{0}"]),
        ("<h3>Advert</h3><div class='ad'>Buy</div><h1>T</h1><script>x()</script><p>{0}</p><form><p>{1}</p></form><footer>end</footer>", ["T", "{0}"]),
    ],
)
def test_pages_keep_what_stands_beside_the_container(body, text):
    long = [prose(91, 60), prose(92, 80)]
    assert html_text.main_text(f"<html><body>{body.format(*long)}</body></html>") == "\n\n".join(t.format(*long) for t in text)


def test_pages_without_an_article_lose_nothing():
    r = random.Random(8)
    for n in range(150):
        words = lambda k: prose(r.randrange(10**6), k).replace("\n", " ")
        main = [f"<p>{words(r.randint(20, 90))}</p>" for _ in range(r.randint(2, 6))]
        before = [f"<h1>{words(9)}</h1>", *[f"<{t}>{words(r.choice([9, 9, 18]))}</{t}>" for t in r.choices(["p", "div", "h2", "blockquote"], k=r.randint(0, 3))]]
        after = [f"<{t}>{words(9)}</{t}>" for t in r.choices(["p", "section", "div"], k=r.randint(0, 3))]
        junk = ["<nav><a href='/'>Home</a></nav>", "<div class='ad'>junk text</div>", "<aside>junk aside</aside>", "<ul><li><a href='#'>junk</a></li></ul>", "<form>junk</form>"]
        for part in (before, after):
            part.insert(r.randint(1, len(part)) if part else 0, r.choice(junk))
        page = "".join([*before, "<div class='body'>", *main, "</div>", *after, "<footer>junk</footer>"])
        want = re.findall(r"<(?:h1|h2|p|div|section|blockquote)>([^<]+)</", page)
        got = html_text.main_text(f"<html><body>{page}</body></html>").split("\n\n")
        dropped = [w for w in want if w not in got]
        # A heading just before what is left out leads to that, and goes with it.
        assert all(re.search(rf"<h2>{re.escape(w)}</h2>(<nav|<div class='ad'|<aside|<ul|<form|<footer)", page) for w in dropped), page
        assert [g for g in got if g not in want] == []


def test_two_thirds_kept_are_seen_without_sentences(spark):
    """Texts of one line without sentence ends, and of one long word: two thirds kept never score under 0.2, other texts do."""
    r = random.Random(11)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(n))
    texts = [words(n) for n in (30, 100, 400, 3000)] + ["".join(r.choice("abc") for _ in range(5000))] + [" | ".join(words(1) for _ in range(200))]
    rows = [(i, t, t[: len(t) - len(t) // 3] + words(len(t) // 15), words(200)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string")
    fp = {(x["id"], x["which"]): x["fp"] for x in multiset_hash.fingerprints(df, ["id"], ["a", "b", "c"]).collect()}
    pairs = spark.createDataFrame([(i, fp[i, 0], fp[i, k], k) for i in range(len(texts)) for k in (1, 2)], "id long, a array<long>, b array<long>, k int")
    near = {(x["id"], x["k"]): x["n"] for x in pairs.select("id", "k", multiset_hash.likeness(F.col("a"), F.col("b")).alias("n")).collect()}
    assert all(near[i, 1] > 0.2 and near[i, 1] > near[i, 2] + 0.1 for i in range(len(texts))), near


def test_label_propagation_against_a_plain_one(spark):
    """Rounds, quotas and moves of a plain loop over the same blocks and the same random numbers."""
    r = random.Random(6)
    shards, rounds = 5, 6
    blocks = {(u, o): [o, r.choice([1, 2, 5, 40]), 1] for u in range(120) for o in r.sample(range(shards), r.choice([1, 1, 2, 3, 5]))}
    rows = [(u, o, s, b, n) for (u, o), (s, b, n) in blocks.items()]
    df = spark.createDataFrame(rows, "unit long, origin int, shard int, bytes long, rows long").repartition(3)
    draws = df.select("unit").distinct()
    draw = {x["unit"]: x["u"] for x in draws.select("unit", F.array(*[sharding._uniform(F.col("unit"), F.lit(k)) for k in range(rounds)]).alias("u")).collect()}
    cap = sum(b for _, b, _ in blocks.values()) / shards * (1 + sharding.SLACK)
    for number in range(rounds):
        votes: dict = {}
        for (u, _), (s, b, _) in blocks.items():
            votes.setdefault(u, Counter())[s] += b
        wish = {u: max(v, key=lambda s: (v[s], -s)) for u, v in votes.items()}
        load, into, out = Counter(), Counter(), Counter()
        for (u, _), (s, b, _) in blocks.items():
            load[s] += b
            if wish[u] != s:
                into[wish[u]] += b
                out[s] += b
        if not into:
            break
        admit = [min(1.0, max(0.0, cap - load[s]) / max(into[s] - out[s], 1)) if into[s] > out[s] else 1.0 for s in range(shards)]
        for (u, _), block in blocks.items():
            if draw[u][number] < admit[wish[u]] or number == rounds - 1:
                block[0] = wish[u]
    got = {(x["unit"], x["origin"]): x["shard"] for x in sharding.propagate(df, shards, rounds).collect()}
    assert got == {k: v[0] for k, v in blocks.items()}
    assert all(len({s for (u, _), s in got.items() if u == unit}) == 1 for unit in range(120))


@pytest.mark.parametrize("cumulative", [[5.0], [1.0, 1.0, 4.0], [0.0, 0.0, 3.0, 7.5, 7.5, 9.0]])
def test_places_in_running_sums(spark, cumulative):
    at = [-1.0, 0.0, 0.5, 1.0, 3.9, 4.0, 7.5, 8.0, 9.0, 100.0]
    got = [x[0] for x in spark.createDataFrame([(a,) for a in at], "a double").select(sharding._pick(cumulative, F.col("a"))).collect()]
    assert got == [min(sum(c <= a for c in cumulative), len(cumulative) - 1) for a in at]
