"""The registered queries themselves: their columns, and what they hold against plain Python over whole small tables."""

import hashlib
import re
import zlib

import pandas as pd
import pytest

P = pytest.importorskip("public_tokenizers")

from sheafline.llm import queries as llm, token_counts  # noqa: E402

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs():
    d = pd.read_parquet(f"{DATA}/documents.parquet").sort_values("doc_id")
    return [(int(r.doc_id), r.text if isinstance(r.text, str) else None, r.source if isinstance(r.source, str) else None) for r in d.itertuples()]


def rows(spark, name, columns):
    out = llm.queries()[name](spark, DATA)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema if f.name in columns] == list(columns.items())
    return [r.asDict() for r in out.collect()]


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def test_op1(spark, docs):
    import tiktoken
    from tiktoken.load import load_tiktoken_bpe

    enc = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=load_tiktoken_bpe(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = rows(spark, "op1_byte_bpe", {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"})
    want = {}
    for i, t, _ in docs:
        ids = enc.encode_ordinary(t or "")
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(t or ""))
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got} == want


def test_op2(spark, docs):
    got = rows(spark, "op2_kk_sharding", {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"})
    b = {i: (t or "").encode() for i, t, _ in docs}
    assert {r["doc_id"]: (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in got} == {i: (len(x) + 1, zlib.crc32(x), "bytes", None) for i, x in b.items()}
    shard_of, sums = {}, [0] * 8
    for r in got:
        assert shard_of.setdefault(b[r["doc_id"]], r["shard"]) == r["shard"]
        sums[r["shard"]] += r["size"]
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))
    assert max(sums) - min(sums) <= max(r["size"] for r in got)


def test_op3(spark, docs):
    got = llm.queries()["op3_quality_cotraining"](spark, DATA).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i, _, _ in docs]
    assert {type(r["kept"]) for r in got} == {bool}


def test_op4(spark, docs):
    got = rows(spark, "op4_spotsigs", {
        "doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double",
    })
    texts = [t or "" for _, t, _ in docs]
    parts = lambda f: {f[k : k + 8] for k in range(0, len(f), 8)}
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(docs)
    seen = {}
    for k, (i, _, _) in enumerate(docs):
        t, following, r = texts[k], texts[(k + 1) % len(docs)], by_id[i]
        half = len(t) // 2
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), sha(t[: len(t) - half] + following[:half]))
        assert seen.setdefault(t, r["fingerprint"]) == r["fingerprint"]
        for other, near in ((r["edited_fingerprint"], r["near_edited"]), (by_id[docs[(k + 1) % len(docs)][0]]["fingerprint"], r["near_next"])):
            x, y = parts(r["fingerprint"]), parts(other)
            assert near == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)


def test_op5(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op5_host_rules", {
        "doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean",
    })}
    assert len(got) == len(docs)
    for i, t, _ in docs:
        w, r = WORD.findall(t or ""), got[i]
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        grams, repeated = {}, set()
        for k in range(len(w) - 4):
            grams.setdefault(tuple(w[k : k + 5]), []).append(k)
        for at in grams.values():
            repeated |= {k + j for k in at for j in range(5)} if len(at) > 1 else set()
        n = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeated))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == n
        assert r["base_failed"] == (n[0] < 10 or 100 * n[4] > 20 * n[0])
        assert not (r["base_failed"] and r["kept"])


def test_op6(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op6_line_join", {"doc_id": "bigint", "n_lines": "bigint", "n_removed": "bigint", "kept_sha256": "string"})}
    sets, removed = [], {}
    texts = {}
    for i, t, _ in docs:
        kept = []
        for line in (t or "").split("\n"):
            s = set(WORD.findall(line))
            if s and any(len(s & o) >= 0.8 * len(s | o) - 1e-12 for o in sets):
                removed[i] = removed.get(i, 0) + 1
            else:
                kept.append(line)
            if s:
                sets.append(s)
        texts[i] = "\n".join(kept)
    for i, t, _ in docs:
        assert got[i]["n_removed"] == removed.get(i, 0)
        assert got[i]["n_lines"] == (0 if t is None else t.count("\n") + 1)
        assert got[i]["kept_sha256"] == (None if t is None else sha(texts[i]))


def test_op7(spark, docs):
    import xxhash

    got = rows(spark, "op7_simhash_mih", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    prints = {}
    for i, t, _ in docs:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        grams = [" ".join(w[k : k + 3]) for k in range(max(len(w) - 2, 1))] if w else []
        h = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    root = {i: i for i in prints}
    for _ in prints:
        before = dict(root)
        for i in prints:
            root[i] = min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 3)
        if root == before:
            break
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{prints[i]:016x}", root[i]) for i in prints}


def test_op8(spark):
    got = {r["page_id"]: r for r in rows(spark, "op8_url_trees", {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"})}
    rules = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
    pages = pd.read_parquet(f"{DATA}/pages.parquet")
    assert len(got) == len(pages)
    for p in pages.itertuples():
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", p.url or "")
        host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        r = got[int(p.page_id)]
        assert (r["host"], r["path"]) == (host, path)
        if fits:
            best = max(fits, key=lambda f: len(f[1] + f[2]))
            assert (r["rule"], r["verdict"]) == (best[1] + best[2], best[0])
        else:
            assert r["rule"] is None and r["verdict"] in ("allow", "block")


def test_op9(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    count = {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t, _ in docs}
    got = rows(spark, "op9_token_counts", {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"})
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {i: (len((t or "").encode()), count[i], count[i] > 1024) for i, t, _ in docs}
    # a cache that knows part of the texts, some of them twice
    table, cache = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text"), str(tmp_path / "cache")
    token_counts.token_counts(table.filter("doc_id < 20"), P.path("byte_bpe_50k.json"), cache).count()
    known = spark.read.parquet(cache).toPandas()
    spark.createDataFrame(known).write.mode("append").partitionBy("version").parquet(cache)
    again = token_counts.token_counts(table, P.path("byte_bpe_50k.json"), cache).collect()
    assert sorted((r["doc_id"], r["n_tokens"]) for r in again) == sorted(count.items())


def test_op10(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op10_entropy_mix", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"})}
    size = {i: len(WORD.findall(t or "")) for i, t, _ in docs}
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[i] for i, _, x in docs if x == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, free, left = {}, set(sources), 1.5 * sum(size.values())
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * total[s]}
        if not full:
            break
        target.update({s: 2.0 * total[s] for s in full})
        left -= sum(2.0 * total[s] for s in full)
        free -= full
    target.update(share)
    for i, _, s in docs:
        r = got[i]
        assert (r["size"], r["source_size"], r["target"]) == (size[i], total[s], pytest.approx(target[s]))
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["taken"] == 0 or r["taken"] % r["size"] == 0)
    for s in sources:
        taken = sum(got[i]["taken"] for i, _, x in docs if x == s)
        assert abs(taken - target[s]) <= max(size[i] for i, _, x in docs if x == s)
