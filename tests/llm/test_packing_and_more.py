import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkspan.llm import chat, packing, url_filter
from inkspan.llm.queries import URL_RULES, op4_packing, op8_url_filter, op10_chat_format, ranks_path
from inkspan.llm.sharding import assign_shards, lookup_table, write_shards

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"


def test_tokenizer_gives_the_vocabulary_ids():
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    rng = random.Random(0)
    texts = ["", " ", "a  b\n\n c\t", "don't I'll we've", "é漢字🙂\u200d", "x" * 3000, " " * 3000, "<|endoftext|> a", "1234567 8,9.0", "\u00a0\u2003\u3000z"]
    texts += ["".join(chr(rng.choice([32, 10, 65, 97, 233, 0x4E00, 0x1F600, 39, 46, 48])) for _ in range(80)) for _ in range(200)]
    fast = packing.tokenizer(ranks_path())
    for t in texts:
        assert fast.encode(t, disallowed_special=()) == slow.encode(t, add_special_tokens=False).ids


def test_differencing_covers_items_and_balances():
    rng = random.Random(4)
    for n, k in ((1, 1), (3, 7), (50, 9), (200, 60)):
        lengths = [rng.randint(1, 1000) for _ in range(n)]
        windows = packing.difference(lengths, k)
        assert sorted(i for w in windows for i in w) == list(range(n)) and len(windows) == k
        if n >= 3 * k:
            sums = [sum(lengths[i] for i in w) for w in windows]
            assert max(sums) - min(sums) < max(lengths)


@pytest.mark.parametrize("seed", range(6))
def test_windows_hold_every_token_once(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, rng.randint(1, 1023), rng.randint(900, 1023)]) for _ in range(rng.randint(1, 300))]
    windows = packing.pack(lengths, 1024)
    assert all(0 < sum(n for _, _, n in w) <= 1024 for w in windows)
    spans = defaultdict(list)
    for w in windows:
        for i, start, n in w:
            spans[i].append((start, n))
    for i, length in enumerate(lengths):
        at = 0
        for start, n in sorted(spans[i]):
            assert start == at and n > 0
            at += n
        assert at == length
    assert len(windows) <= -(-sum(lengths) // 1024) + 2


def test_packing_query_is_an_exact_round_trip(spark):
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = {r.doc_id: slow.encode(r.text, add_special_tokens=False).ids + [0] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    pieces = op4_packing(spark, SF).collect()
    covered, sequences = Counter(), defaultdict(list)
    for p in pieces:
        ids = np.array(docs[p.doc_id][p.start : p.start + p.length], "<u4")
        assert len(ids) == p.length and zlib.crc32(ids.tobytes()) == p.ids_crc32 and p.doc_tokens == len(docs[p.doc_id])
        covered[p.doc_id] += p.length
        sequences[p.sequence_id].append((p.offset, p.length))
    assert covered == {d: len(ids) for d, ids in docs.items()}
    assert sorted({(p.doc_id, p.start) for p in pieces}) == sorted((p.doc_id, p.start) for p in pieces)
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 0.02 * sum(covered.values())


def test_packing_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "a"), (3, "word " * 60_000), (3, "b")]
    pieces = packing.pack_documents(spark.createDataFrame(rows, DOCS).withColumn("start", F.lit("x")), ranks_path()).collect()
    totals = Counter()
    for p in pieces:
        totals[p.doc_id] += p.length
    assert totals[1] == totals[2] == 1 and totals[None] == 2 and totals[3] == sum({p.doc_tokens for p in pieces if p.doc_id == 3})
    assert all(len(p.ids) == 4 * p.length for p in pieces)
    assert packing.pack_documents(spark.createDataFrame([], DOCS), ranks_path()).count() == 0


def test_special_strings_get_the_ids_of_the_json_tokenizer(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "x  <|endoftext|>  y\n", "<|endoftext|", "<|ENDOFTEXT|> <|endoftext|>s", "don't<|endoftext|>'ll", "q " * 2000 + "<|endoftext|>"]
    found = defaultdict(list)
    for p in packing.pack_documents(spark.createDataFrame(list(enumerate(texts)), DOCS), ranks_path()).collect():
        found[p.doc_id].append((p.start, np.frombuffer(p.ids, "<u4").tolist(), p.doc_tokens))
    for i, t in enumerate(texts):
        ids = [x for _, part, _ in sorted(found[i]) for x in part]
        assert ids == plain.encode(t, add_special_tokens=False).ids + [0] and {n for *_, n in found[i]} == {len(ids)}, t


def test_lookup_table_is_even_and_stable():
    names = [f"s{i}" for i in range(10)]
    table = lookup_table(names, 1009)
    counts = Counter(table)
    assert set(counts) == set(range(10)) and max(counts.values()) - min(counts.values()) <= 1
    more = lookup_table([*names, "s10"], 1009)
    assert sum(a != b for a, b in zip(table, more)) < 0.35 * 1009
    assert lookup_table(["only"], 2) == [0, 0]
    for bad in ((names, 1000), ([], 7), (["a", "a"], 7), (names, 7)):
        with pytest.raises(ValueError):
            lookup_table(*bad)


def test_sharding_edge_cases(spark, tmp_path):
    rows = [(1, "x"), (1, "y"), (None, "z"), (None, None)]
    placed = assign_shards(spark.createDataFrame(rows, "doc_id long, table_slot string").withColumn("shard", F.lit("mine")), "doc_id", ["a", "b", "c"], 7)
    found = placed.collect()
    assert len(found) == 4 and len({r.shard_id for r in found if r.doc_id == 1}) == 1 and len({r.shard_id for r in found if r.doc_id is None}) == 1
    assert all(r.shard in "abc" for r in found) and {r.table_slot for r in found} == {"x", "y", "z", None}
    assert assign_shards(spark.createDataFrame([], DOCS), "doc_id", ["a"], 7).count() == 0
    write_shards(spark.range(100).toDF("doc_id"), str(tmp_path / "s"), "doc_id", ["a", "b"], 101)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == 100 and back.select("shard_id").distinct().count() == 2


def plain_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    for mark in "?#":
        rest = rest.split(mark, 1)[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


def plain_rule(host, path):
    best = (None, None)
    for rule, verdict in URL_RULES:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and len(rule) > len(best[0] or ""):
            best = (rule, verdict)
    return best


def test_url_rules_match_plain_version(spark):
    urls = ["http://a.NET/x?y#z", "https://Example.net/en/1", "http://example.net/en", "http://example.net", "x://example.com/de/", "http://org/fr/", "http://morg/fr/", "http://a.org/fr/#t",
            None, "", "no scheme", "://", "http://?q", "http://a.net?b://c/d", "http://a#b/c", "h://badexample.net/en/", "http://sub.example.com/de/x/", "http://É.net/é", "http://x.net\n/en"]
    trees = url_filter.Trees(0.0, [], {}, 0.5)
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit(7))
    for r in url_filter.filter_urls(rows, URL_RULES, trees).collect():
        host, path = plain_url(urls[r.page_id])
        assert (r.host, r.path) == (host, path), urls[r.page_id]
        rule, verdict = plain_rule(host, path)
        assert r.rule == rule and r.verdict == (verdict or "block")
    assert url_filter.filter_urls(rows.limit(0), URL_RULES, trees).count() == 0


def test_url_query_on_pages(spark):
    for r in op8_url_filter(spark, SF).collect():
        rule, verdict = plain_rule(r.host, r.path)
        assert r.rule == rule and (verdict or r.verdict) == r.verdict
        if rule is None:
            assert (r.verdict == "block") == ("-" in r.host)


def test_trees_on_held_out_urls(spark):
    labelled = url_filter.seed_labels(spark, 3000)
    held = F.pmod(F.xxhash64("url", F.lit("split")), F.lit(4)) == 0
    trees = url_filter.train(labelled.filter(~held))
    judged = url_filter.filter_urls(labelled.filter(held), [], trees).collect()
    assert np.mean([(r.verdict == "block") == (r.blocked == 1) for r in judged]) > 0.9
    assert url_filter.train(labelled.limit(0)).trees == []
    score = {tuple(r.asDict().items()): r.block_score for r in judged}
    made = url_filter.features(F.col("url"), trees.suffix_rates, trees.default_rate)
    for r in labelled.filter(held).select("url", *[c.alias(n) for n, c in made.items()]).limit(50).collect():
        row = tuple(r[f] for f in url_filter.FEATURES)
        z = trees.base + sum(url_filter._value(t, row) for t in trees.trees)
        own = next(s for k, s in score.items() if dict(k)["url"] == r.url)
        assert abs(own - 1 / (1 + np.exp(-z))) < 1e-9


def test_trees_use_the_lexical_features_and_hold_on_new_names(spark):
    """Names of the test URLs were in no training URL, and no single feature decides."""
    trees = url_filter.train(url_filter.seed_labels(spark))
    new = url_filter.seed_labels(spark, 3000, seed=1).withColumn("url", F.translate("url", "aeiou", "éyäöü"))
    judged = url_filter.filter_urls(new, [], trees).collect()
    assert np.mean([(r.verdict == "block") == (r.blocked == 1) for r in judged]) > 0.9

    def used(node):
        return set() if isinstance(node, float) else {node[0]} | used(node[2]) | used(node[3])

    features = set().union(*map(used, trees.trees))
    assert {"hyphens", "depth", "digit_ratio", "parameters", "suffix_rate"} <= features and features & {"length", "host_length", "entropy"}
    hyphens = [("-" in plain_url(r.url)[0]) == (r.blocked == 1) for r in judged]
    assert np.mean([(r.verdict == "block") == (r.blocked == 1) for r in judged]) > np.mean(hyphens)


def test_url_filter_on_long_and_repeated_urls(spark):
    trees = url_filter.train(url_filter.seed_labels(spark, 500))
    long_ = "http://a.com/" + "x/" * 100_000
    rows = spark.createDataFrame([(1, long_), (2, "http://b.de/"), (2, "http://b.de/")], "page_id long, url string").withColumn("HOST", F.lit(1)).withColumn("made_features", F.lit("m"))
    found = url_filter.filter_urls(rows.drop("made_features"), [], trees).collect()
    assert len(found) == 3 and len(next(r for r in found if r.page_id == 1).path) == 200_001
    assert len({(r.verdict, r.block_score) for r in found if r.page_id == 2}) == 1


def test_chat_links_orders_and_validates(spark):
    messages = spark.createDataFrame([(1, 0, "user", 'hi "x"'), (1, 1, "assistant", None), (1, 3, None, "done"), (None, 0, "user", "n"), (1, 3, None, "done")], "conv_id long, turn long, role string, text string")
    calls = spark.createDataFrame([(1, 1, "a", "get", '{"b": 1, "a": "x"}'), (1, 1, "b", "get", '{"a": 5, "z": [1]}'), (1, 1, "c", "nope", "[1]"), (1, 2, None, "get", "{")], chat.CALLS)
    results = spark.createDataFrame([(1, 0, "a", "ok"), (1, 2, "zz", "lost"), (1, 2, "b", None)], chat.RESULTS)
    schemas = spark.createDataFrame([("get", "a", "string", True), ("get", "b", "number", True)], chat.SCHEMAS)
    rows = chat.format_chat(messages, calls, results, schemas).orderBy("conv_id", "seq").collect()
    one = [r for r in rows if r.conv_id == 1]
    assert [r.seq for r in one] == list(range(11)) and len(rows) == 12
    at = {(r.kind, r.call_id): r for r in one}
    assert at["call", "a"].json == '{"arguments":{"a":"x","b":1},"id":"a","name":"get","type":"call"}' and at["call", "a"].errors == []
    assert at["call", "b"].errors == ["a is integer, not string", "missing b"]
    assert at["call", "c"].errors == ["arguments are not an object", "tool has no schema"] and not at["call", "c"].linked
    assert at["call", None].errors == ["arguments are not an object"]
    for call in ("a", "b"):
        assert at["call", call].seq < at["result", call].seq and at["call", call].linked and at["result", call].linked
    assert not at["result", "zz"].linked
    assert chat.format_chat(messages.limit(0)).count() == 0


def plain_order(calls, results):
    """Due turn and depth of each call, by walking its chain; None where the chain goes round in a circle."""
    own = {i: t for t, i, _ in calls}
    parent = {i: p for _, i, p in calls}
    settled = {i: max([own[i], *[t for t, j in results if j == i]]) for i in own}
    placed = {}
    for i in own:
        seen, due, at = [], None, parent[i]
        while at in own and at not in seen:
            seen.append(at)
            due = settled[at] if due is None else max(due, settled[at])
            at = parent[at]
        placed[i] = None if at in own else (due, len(seen))
    return placed


def test_chains_of_calls_match_a_plain_walk(spark):
    rng = random.Random(11)
    calls = [(rng.randint(0, 40), f"c{i}", rng.choice([None, "gone", f"c{rng.randint(0, 79)}", f"c{max(0, i - 1)}"])) for i in range(80)]
    calls += [(5, f"d{i}", f"d{i - 1}") for i in range(50)]
    rng.shuffle(calls)
    results = [(rng.randint(0, 60), rng.choice(calls)[1]) for _ in range(90)]
    wanted = plain_order(calls, results)
    events = chat.format_chat(
        spark.createDataFrame([], "conv_id long, turn long, role string, text string"),
        spark.createDataFrame([(1, t, i, "get", "{}", p) for t, i, p in calls], chat.CALLS + ", after_id string"),
        spark.createDataFrame([(1, t, i, "r") for t, i in results], chat.RESULTS),
        spark.createDataFrame([("get", None, None, None)], chat.SCHEMAS),
    ).collect()
    own = {i: t for t, i, _ in calls}
    place = {}
    for r in events:
        due, depth = wanted[r.call_id] or (None, 0)
        if r.kind == "call":
            assert (r.turn, r.depth) == (max(own[r.call_id], -1 if due is None else due), depth)
            assert r.errors == ([] if wanted[r.call_id] else ["depends on itself"])
        place.setdefault((r.kind, r.call_id), []).append(r.seq)
    assert sorted(r.seq for r in events) == list(range(len(events))) and None in wanted.values() and max(w[1] for w in wanted.values() if w) >= 49
    for (kind, i), at in place.items():
        if kind == "result":
            assert min(at) > place["call", i][0]
    for _, i, p in calls:
        if p in own and wanted[i]:
            assert place["call", i][0] > max(place["call", p] + place.get(("result", p), []))


def test_chat_query_links_and_rejects(spark):
    found = op10_chat_format(spark, "/root/testdata/sf0.001").collect()
    kinds = Counter(r.kind for r in found)
    assert min(kinds["message"], kinds["call"], kinds["result"]) > 0 and max(r.depth or 0 for r in found) >= 2
    assert {r.linked for r in found if r.kind == "call"} == {True, False} and len({r.errors for r in found if r.kind == "call"}) > 4


def test_chat_with_long_texts_and_clashing_columns(spark):
    messages = spark.createDataFrame([(1, 0, "user", "x" * 300_000, "m")], "conv_id long, turn long, role string, text string, level string").withColumn("depth", F.lit("d"))
    long_ = '{"a": "' + "y" * 300_000 + '"}'
    calls = spark.createDataFrame([(1, 1, "a", "get", long_, 1)] * 2, chat.CALLS + ", seq int")
    results = spark.createDataFrame([(1, None, "a", None)], chat.RESULTS).withColumn("due", F.lit(3))
    found = chat.format_chat(messages, calls, results).orderBy("seq").collect()
    assert [r.kind for r in found] == ["message", "call", "call", "result"] and len(found[1].json) > 300_000 and found[3].turn == 1


def test_long_conversations_are_numbered_across_stretches(spark):
    turns = list(range(1500)) * 2
    random.Random(0).shuffle(turns)
    rows = spark.createDataFrame([(1, t, "user", f"m{t}") for t in turns], "conv_id long, turn long, role string, text string")
    found = sorted((r.seq, r.turn) for r in chat.format_chat(rows.withColumn("seq", F.lit("x"))).collect())
    assert [s for s, _ in found] == list(range(3000)) and [t for _, t in found] == sorted(turns)


def test_canonical_json(spark):
    rows = spark.createDataFrame([('{"b":{"d":1,"c":[2, 1]},"a":null}',), ("no",), (None,)], "j string")
    assert [r.c for r in rows.select(chat.canonical(F.col("j")).alias("c")).collect()] == ['{"a":null,"b":{"c":[2,1],"d":1}}', None, None]


def test_pieces_are_handed_on_before_many_are_held(monkeypatch):
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from inkspan.llm import packing

    monkeypatch.setattr(packing, "tokenizer", lambda _: SimpleNamespace(encode_to_numpy=lambda text, allowed_special: np.ones(len(text), np.uint32)))
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1500)), "text": ["x" * 5200] * 1500})
    found = list(packing._rows([batch], "", 1024, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]))
    assert max(x.num_rows for x in found) < 4 * packing.HELD < 4096 and sum(sum(x.column(2).to_pylist()) for x in found) == 1500 * 5201
