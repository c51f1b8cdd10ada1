import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.llm import ann, chat, decontaminate, langid, licenses, packing, secrets, sharding, simhash, toxicity
from veilframe.llm.components import components
from veilframe.llm.tokens import encoder

ODD = [(1, None), (2, ""), (None, "only a null id here and some words"), (3, "same text twice"), (3, "same text twice"), (3, "another text, one id"), (4, "  \t\n "), (5, "ÀÉ Straße ǅ 東京 🙂 é"), (6, "word " * 30000)]
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, bucket string, words string, slot string"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", None, "y") for r in ODD], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def brute_decontaminate(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: (t or "").translate({k: k + 32 for k in range(65, 91)})
    windows = set()
    for item, text in items:
        w = word.findall(low(text))
        if item is not None and w:
            windows |= {(item, tuple(w[s : s + 10])) for s in range(max(len(w) - 10, 0) + 1)}
    out = []
    for doc, text in docs:
        w, hit, found = word.findall(low(text)), set(), set()
        for item, g in windows:
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit |= set(range(p, p + len(g)))
                    found.add(str(item))
        out.append((doc, len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    words = [f"w{k}" for k in range(12)]
    text = lambda n: " ".join(rng.choice(words, n))
    items = [(k, text(int(rng.integers(1, 25)))) for k in range(12)] + [(3, text(11)), (None, text(12)), (50, None), (51, "!!"), (52, "W1, w1. W1")]
    docs = [(k, text(15) + " " + (items[k % 12][1]).upper() + "; " + text(9)) for k in range(40)] + [(None, items[1][1]), (7, items[2][1]), (7, items[2][1]), (90, None), (91, ""), (92, "w1 w1 w1 w1")]
    made = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r.item_ids), r.contaminated) for r in made.collect()), key=str)
    assert got == brute_decontaminate(docs, items)


def test_decontamination_odd_and_empty(spark, odd, none):
    items = spark.createDataFrame([(1, "Same text twice", "clash")], "item_id long, text string, doc_id string")
    assert sorted(r.n_hit for r in decontaminate.decontaminate(odd, items).collect()) == [0] * 7 + [3, 3]
    assert decontaminate.decontaminate(none, items).count() == 0
    assert decontaminate.decontaminate(odd, items.limit(0)).where("contaminated").count() == 0


def test_proximity_equals_brute_force(spark):
    rng = np.random.default_rng(11)
    words = list("abcdefgh")
    docs = [(k, " ".join(rng.choice(words, int(rng.integers(0, 30))))) for k in range(40)] + [(None, "a b c"), (41, None)]
    items = [(9, "a b c"), (10, "h g"), (11, "d"), (12, "a z")]
    index = decontaminate.Index(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    freq = Counter(w for _, t in docs for w in (t or "").split())
    for slop in (1, 4):
        got = {(r.item_id, r.pos, r.doc_id if r.doc_key % 2 == 0 else None) for r in index.proximity(slop).collect()}
        want = set()
        for item, text in items:
            terms = set(text.split())
            rare = min(freq[w] for w in terms)
            for doc, t in docs:
                w = (t or "").split()
                for p, word in enumerate(w):
                    if word in terms and freq[word] == rare and all(x in w[max(0, p - slop) : p + slop + 1] for x in terms):
                        want.add((item, p, doc))
        ties = [item for item, text in items if sum(freq[w] == min(freq[x] for x in text.split()) for w in text.split()) > 1]
        assert not ties and got == want


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    grams = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints_and_components_equal_brute_force(spark, odd, none):
    rng = np.random.default_rng(1)
    base = [" ".join(rng.choice([f"v{k}" for k in range(300)], 120)) for _ in range(12)]
    docs = [(k, base[k % 12] if k < 12 else " ".join([*base[k % 12].split()[: 118 - k % 5], "tail"])) for k in range(60)] + [(100, "A b"), (101, "a B"), (102, None), (103, "")]
    made = {r.doc_id: r for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    prints = {d: brute_fingerprint(t) for d, t in docs}
    assert {d: f"{p:016x}" for d, p in prints.items()} == {d: r.fingerprint for d, r in made.items()}
    root = {d: d for d in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                a_, b_ = find(a), find(b)
                root[max(a_, b_)] = min(a_, b_)
    assert {d: find(d) for d in prints} == {d: r.component_id for d, r in made.items()}
    assert simhash.near_duplicates(none).count() == 0 and simhash.near_duplicates(odd).count() == len(ODD)


def test_every_link_is_found_once(spark):
    rng = np.random.default_rng(7)
    seeds = rng.integers(-(2**63), 2**63 - 1, 20)
    values = {int(s) for s in seeds}
    for s in seeds:
        for n in range(1, 7):
            values.add(int(np.bitwise_xor(s, np.bitwise_or.reduce([np.int64(1) << np.int64(b) if b < 63 else np.int64(-(2**63)) for b in rng.choice(64, n, replace=False)]))))
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    want = {(a, b) for a in values for b in values if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 4}
    for segments in (2, 3, 4):
        got = [(r.u, r.v) for r in simhash.links(nodes, 4, segments).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 102)], "u long, v long")
    assert {r.node: r.root for r in components(chain).collect()} == {k: 0 for k in range(61)} | {100: 100, 101: 100, 102: 100}
    assert components(chain.limit(0)).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcXYZ0'  \n\t.é東🙂́ |<>")), max_size=60))
def test_fast_ids_equal_the_tokenizers(text):
    assert encoder()(text) == encoder().exact(text)
    assert encoder().text(encoder()(text)) == text


def test_ids_are_those_of_the_plain_file():
    from tokenizers import Tokenizer

    from veilframe.llm.tokens import vocabulary_path

    plain = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    for text in ("a<|endoftext|>b", " <|endoftext|>  x", "<|endoftext", "plain text, Straße 東京 🙂", "", "<|endoftext|>" * 3):
        assert encoder(added=True)(text) == plain.encode(text, add_special_tokens=False).ids
        assert encoder(added=True).text(encoder(added=True)(text)) == text
    assert 50256 not in encoder()("a<|endoftext|>b")
    slow = type(encoder())(vocabulary_path("byte_bpe_50k.json"))  # without the ranks
    assert slow("é東🙂 x") == encoder()("é東🙂 x") and slow.text(slow("é東🙂 x")) == "é東🙂 x"


def brute_pack(docs, limits, pool):
    """The heuristic once more, over plain lists: (doc, start, length, sequence, offset)."""
    most, out, wait, left, used, number, following = min(limits[0], limits[2]), [], [], list(limits), 0, None, 0
    bearing = lambda start, n: n - (start == 0)
    queue = [(k, start, min(most, n - start)) for k, n in enumerate(docs) for start in range(0, n, most)]

    def place(k, start, n):
        nonlocal used, number, following, left
        if not used:
            number, following = following, following + 1
        out.append((k, start, n, number, used))
        used, left = used + n, [left[0] - n, left[1] - 1, left[2] - bearing(start, n)]
        if not (left[0] and left[1]):
            used, left = 0, list(limits)

    def step():
        nonlocal used, left
        fits = [(sum(a * b / m / m for a, b, m in zip((n, 1, bearing(start, n)), left, limits)), -i) for i, (k, start, n) in enumerate(wait) if n <= left[0] and 1 <= left[1] and bearing(start, n) <= left[2]]
        if fits:
            place(*wait.pop(-max(fits)[1]))
            return
        i = max(range(len(wait)), key=lambda i: (wait[i][2], -i))
        k, start, n = wait[i]
        room = min(n, left[0], left[2] + (start == 0))
        if room >= (packing.LEAST_CUT if used else 1) and left[1] >= 1:
            wait.pop(i)
            wait.append((k, start + room, n - room))
            place(k, start, room)
        else:
            used, left = 0, list(limits)

    for piece in queue:
        if piece[2] == most:
            out.append((*piece, following, 0))
            following += 1
            continue
        wait.append(piece)
        while len(wait) > pool:
            step()
    while wait:
        step()
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 150), max_size=60), st.sampled_from([(64, 3, 64), (64, 4, 32), (64, 64, 60), (128, 2, 64)]), st.integers(1, 9))
def test_packing_choices_equal_brute_force(docs, limits, pool):
    # Limits that are powers of two, so that equal scores are equal in floating point too.
    limits = tuple(limits) if limits[2] != 60 else (64, 64, 32)
    limits = (limits[0], 1 << (limits[1].bit_length() - 1), limits[2])
    packer = packing.Packer(limits, pool)
    for k, n in enumerate(docs):
        packer.add(k, np.arange(n, dtype=np.uint32))
    packer.finish()
    assert [(r[0], r[1], r[2], r[5], r[6]) for r in packer.out] == brute_pack(docs, limits, pool)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 90), st.integers(0, 90)), max_size=40), st.integers(1, 5))
def test_packing_keeps_every_id_and_every_limit(docs, segments):
    packer = packing.Packer((40, segments, 25), pool=8)
    for k, (n, lossy) in enumerate(docs):
        packer.add(k, np.arange(n, dtype=np.uint32), (np.arange(n) < lossy).astype(np.int64))
    packer.finish()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for doc, start, length, _, _, sequence, offset, loss in packer.out:
        by_doc[doc].append((start, length))
        by_sequence[sequence].append((offset, length, loss))
    for k, (n, _) in enumerate(docs):
        ends = 0
        for start, length in sorted(by_doc[k]):
            assert start == ends and length > 0
            ends += length
        assert ends == n
    for parts in by_sequence.values():
        ends = 0
        for offset, length, _ in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 40 and len(parts) <= segments and sum(p[2] for p in parts) <= 25


def check_sequences(made, limits=(packing.LENGTH, packing.MOST_SEGMENTS, packing.MOST_LOSS)):
    """Offsets without gaps, limits kept; the share of sequences that is filled."""
    by_sequence = defaultdict(list)
    for r in made:
        by_sequence[r.sequence_id].append((r.offset, r.length, r.loss_tokens))
    for parts in by_sequence.values():
        ends = 0
        for offset, length, _ in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= limits[0] and len(parts) <= limits[1] and sum(p[2] for p in parts) <= limits[2]
    return sum(r.length for r in made) / (len(by_sequence) * limits[0])


def test_packing_of_documents(spark, odd, none):
    made = packing.pack(odd.coalesce(1)).collect()
    assert sum(r.length for r in made) == sum(len(encoder(added=True)(t or "")) + 1 for _, t in ODD)
    ids = encoder().exact("word " * 30000) + [1]
    for r in made:
        if r.doc_id == 6:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids)
    assert check_sequences(made) > 0.9
    assert packing.pack(none).count() == 0
    examples = spark.createDataFrame([(1, [5, 6, 7], [0, 1, 1]), (2, None, None)], "doc_id long, ids array<int>, marks array<int>")
    assert [(r.doc_id, r.loss_tokens) for r in packing.pack_examples(examples).collect()] == [(1, 2)]


def test_packing_fills_sequences_from_many_small_partitions(spark):
    rng = np.random.default_rng(5)
    docs = [(k, "word " * int(rng.integers(0, 400)) + "<|endoftext|>" * (k % 3)) for k in range(400)]
    made = packing.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(100)).collect()
    assert check_sequences(made) > 0.9
    by_doc = defaultdict(list)
    for r in made:
        by_doc[r.doc_id].append((r.start, r.length, r.ids_crc32))
    for k, text in docs:
        ids = np.array([*encoder(added=True)(text), 1], "<u4")
        assert [c for _, _, c in sorted(by_doc[k])] == [zlib.crc32(ids[a : a + n].tobytes()) for a, n, _ in sorted(by_doc[k])] and sum(n for _, n, _ in by_doc[k]) == len(ids)
    tight = packing.pack(spark.createDataFrame(docs, "doc_id long, text string"), segments=12, loss=1000).collect()
    assert 0.4 < check_sequences(tight, (2048, 12, 1000)) < 0.5  # the third limit binds


def test_sharding(spark, odd, none):
    made = sharding.shard(odd, shards=4, bucket_bytes=1000).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text is None, r.text) for r in made) == sorted((d is None, d, t is None, t) for d, t in ODD)
    slots = defaultdict(list)
    for r in made:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard(odd.repartition(3), shards=4, bucket_bytes=1000).collect()
    assert sorted((str(r.text), r.shard, r.slot) for r in again) == sorted((str(r.text), r.shard, r.slot) for r in made)
    assert sharding.shard(none).count() == 0
    order = sharding.fisher_yates(1000, np.random.default_rng(1))
    assert sorted(order) == list(range(1000)) and abs(np.corrcoef(order, np.arange(1000))[0, 1]) < 0.15


def test_sharding_splits_hot_rows(spark, tmp_path):
    for row in ((None, None), (7, "same " * 10), (None, "same " * 10)):
        hot = spark.createDataFrame([row] * 3000 + [(k, f"text {k}") for k in range(500)], "doc_id long, text string")
        made = sharding.shard(hot, shards=8, bucket_bytes=8000).select("doc_id", "text", "bucket", "shard", "slot").collect()
        sizes = Counter(r.bucket for r in made)
        assert max(sizes.values()) < 300 and len(sizes) > 20 and len(made) == 3500
        slots = defaultdict(list)
        for r in made:
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and {len(v) for v in slots.values()} <= {437, 438}
    sharding.write_shards(hot, f"{tmp_path}/shards", shards=4)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == 3500 and {r.n for r in back.groupBy("shard").agg(F.count("*").alias("n")).collect()} == {875}


def test_bucket_offsets_over_many_blocks(spark):
    counts = spark.range(10_000).select(F.col("id").alias("bucket"), (F.col("id") % 7).alias("n"))
    got = {r.bucket: r._sharding_before for r in sharding.offsets(counts).collect()}
    total = 0
    for k in range(10_000):
        assert got[k] == total
        total += k % 7


def test_sharding_query(spark):
    from veilframe.llm import queries

    made = {r.doc_id: r for r in queries.op9_sharding(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        raw = (r.text or "").encode()
        got = made[r.doc_id]
        assert (got["size"], got.text_crc32, got.law, got.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)


def brute_spans(text):
    text = text or ""
    spans = [("assign", m.start(), m.end()) for m in re.finditer(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    spans += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    spans += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return sorted(spans, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "api_key", "ſecret", ":", "=", " ", '"', "abc123", "x", "AKIA", "ABCDEFGH01234567", "deadbeef" * 3, "\n", "é🙂", "\n"]), max_size=14).map("".join))
def test_base_secrets_equal_brute_force(text):
    found = secrets.scan(text)
    assert [s for s in found if s[0] != "lexed"] == brute_spans(text)


def test_lexed_secrets():
    source = 'base = "Zx9!kQ2#vL8m"\ndb_passphrase = base\nnote: hello\nprivate_key => \'q8W2e7R1t5Y9u3I0\'\nauth.bearer = "Ab3" + "dE6fG9hJ2kL"\ntitle = "Zx9!kQ2#vL8m"\npassphrase = changeme'
    found = [source[a:b] for kind, a, b in secrets.scan(source) if kind == "lexed"]
    assert found == ["Zx9!kQ2#vL8m", "q8W2e7R1t5Y9u3I0", "Ab3", "dE6fG9hJ2kL"]
    assert secrets.scan(None) == [] and secrets.scan("plain prose: nothing = here") == []
    assert secrets.redact("x token = abcdef12 y") == "x token = [SECRET] y" and secrets.redact(None) is None


KEY = "Zx9!kQ2#vL8m"


def lexed(text):
    return [text[a:b] for kind, a, b in secrets.scan(text) if kind == "lexed"]


@pytest.mark.parametrize("source", [
    'db_passphrase               = "@"', 'private_key = """\n-----BEGIN KEY-----\n@\n-----END KEY-----\n"""', "db_pwd = \\\n  '@'", 'db_pwd = ("@")', "db_pwd = (\n  '@'  # why\n)", "private_key: |\n  @\nnext: 3",
    "private_key: >-\n  -----BEGIN KEY-----\n  @\n\nnext: 3", '<add key="dbPwd" value="@"/>', "- name: DB_PWD\n  value: '@'", '{"name": "DB_PWD", "value": "@"}', "<credential>@</credential>", "const pwd = `@`;", 'db_pwd = rb"@"',
    'String dbPwd = "@";', '"db_pwd": "@",', "db_pwd := '@'", "credentials = ['@', 'x']", "pwd: str = '@'", "base = '@'\ndb_pwd = base", "def f():\n    base = '@'\n    db_pwd = base\n\nelsewhere = base",
])
def test_lexed_syntax(source):
    assert lexed(source.replace("@", KEY)) == [KEY]
    assert KEY not in secrets.redact(source.replace("@", KEY)).split("base = ")[0] or "base = " in source


def test_lexed_nothing():
    for source in (f'pwd = os.getenv("{KEY}")', f"def f():\n    base = '{KEY}'\n\ndb_pwd = base", 'pwd = "two words here"', "pwd = (", 'pwd = """unclosed', "pwd: |", "key = value = ", f"title = '{KEY}'"):
        assert lexed(source) == [], source
    outer = f"base = 'Outer9!kQ2#'\ndef f():\n    base = '{KEY}'\n    a = base\ndb_pwd = base"
    assert lexed(outer) == ["Outer9!kQ2#"]
    grown = 'a = "x1!Y2@z3#W"\n' + "a = a + a\n" * 2000 + "pwd = a"
    assert lexed(grown) == ["x1!Y2@z3#W"]


def quoted_forms(value):
    return [f'"{value}"', f"'{value}'", f'("{value}")', f"\\\n    '{value}'", f'"""{value}"""', f'"{value[:5]}" + "{value[5:]}"', f"(\n '{value[:4]}'\n '{value[4:]}'\n)"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["db_pwd", "title", "apiKeyValue", "note", "clientSecretValue", "colour"]), st.integers(0, 6), st.sampled_from([" = ", "=", " := ", ": ", "  =>  "]), st.integers(0, 999)), max_size=8))
def test_lexed_pairs_of_generated_sources(made):
    lines, want = [], []
    for k, (name, form, sign, number) in enumerate(made):
        value = f"Qw{number:03d}!kQ2#vL8m"
        lines.append(f"{name}_{k}{sign}{quoted_forms(value)[form]}")
        want.append((f"{name}_{k}", value))
    source = "\n".join(lines) + "\n"
    got = [(name, "".join(v for _, _, v in parts)) for name, parts in secrets.pairs(source)]
    assert got == want
    assert all(source[a:b] == v for _, parts in secrets.pairs(source) for a, b, v in parts)
    sensitive = [value for name, value in want if not name.startswith(("title", "note", "colour"))]
    assert "".join(lexed(source)) == "".join(sensitive)


def test_lexed_constants_of_many_parts():
    keys = [f"Zx{k:06d}!kQ#vL" for k in range(300)]
    listed = "parts = [" + ", ".join(f"'{key}'" for key in keys) + "]\n"
    assert lexed(listed + "db_pwd = parts") == lexed(listed + "more = parts\ndb_pwd = more + parts") == keys
    assert lexed(listed.replace(", ", " + ") + "db_pwd = parts") == keys
    grown = f"a = '{keys[0]}'\n" + "".join(f"a = a + '{key}'\n" for key in keys[1:])
    assert lexed(grown + "db_pwd = a") == keys and lexed(grown + "title = a") == []
    assert lexed("a = 'Zx9!'\n" + "b = 'kQ2#'\nc = 'vL8m'\nd = a + b\ne = b + c\ndb_pwd = d + e + a") == ["Zx9!", "kQ2#", "vL8m"]  # shared parts count once
    assert [name for name, _ in secrets.pairs(listed + "name = parts\nvalue = 'x'")][-1] == "".join(keys)


def test_constants_of_many_parts_take_linear_time():
    import time

    listed = "a = [" + ",".join(f"'k{k:05d}'" for k in range(40_000)) + "]\n"
    chain = "pwd = 'Zx9!'\n" + "".join(f"pwd = pwd + 'k{k:05d}'\n" for k in range(20_000))
    for text, most in ((listed + "pwd = a\n" * 10_000, 40_000), (listed + "b = a + 'x'\ndb_pwd = b\n" * 5000, 45_000), (chain, 20_001), (listed + "name = a\nvalue = 'x'\n" * 5000, 0)):
        began = time.process_time()
        found = lexed(text)
        assert time.process_time() - began < 8 and len(found) <= most and (len(found) >= most - 5 or not most)


def test_secret_query_digest(spark):
    import hashlib

    from veilframe.llm import queries

    made = {r.doc_id: r for r in queries.op5_secrets(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        base, got = brute_spans(r.text), made[r.doc_id]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and (got.n_assign, got.n_access, got.n_hex) == tuple(sum(s[0] == k for s in base) for k in ("assign", "access", "hex"))
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got.spans.split(",")) | {""}


def test_lexed_secrets_of_any_width():
    key = "Ab3dE6fG9hJ2kL5x"
    for line in ("pwd{0}=@", "credential:{0}@", "passphrase = @", "pwd: str{0}= @", "pwd:{0}str = @", "x" * 300 + ".pwd = @", "pwd" + ".x" * 300 + " = @"):
        for blanks in (1, 9, 60, 70_000):
            assert lexed(line.format(" " * blanks).replace("@", f'"{key}"')) == [key]
    for before in (0, 1000, 64_000, 65_530, 66_500, 200_000):
        for value in (key, key * 200, key * 10_000):
            assert lexed("x " * (before // 2) + f"passphrase = '{value}' y") == [value]
            assert secrets.redact("x " * (before // 2) + f"pwd = {value} y") == "x " * (before // 2) + "pwd = [SECRET] y"


def test_lexing_takes_linear_time():
    import time

    for text in ("a" * 500_000, "a " * 250_000 + "=", "a" + " " * 500_000, "a=" * 250_000, 'a="' * 170_000, "a: b " * 100_000, "a-" * 250_000, "a=" + '"' + "\\" * 499_999, "a: " + "b " * 250_000, "a:" + " " * 500_000, '"a' * 250_000, 'a="""' * 100_000, "a=(" * 150_000, "a=[" + "x," * 200_000, "a: |\n" * 100_000, "\n".join(" " * k + "def a = b" for k in range(700)), "a=x+\n" * 100_000, "a = b\n" * 100_000):
        began = time.process_time()
        secrets.pairs(text + ":" if ":" not in text and "=" not in text else text)
        assert time.process_time() - began < 8


def test_language(spark, odd, none):
    rows = [(k, t, lang) for k, (t, lang) in enumerate([("the house and the garden are green", "en"), ("das haus und der garten sind grün", "de")] * 30)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.predict("the garden")[0] == "en" and model.predict("der gärtner")[0] == "de"
    assert model.predict(None) == model.predict("12 _ %") == ("und", 0.0)
    made = langid.predict(odd, model).collect()
    assert len(made) == len(ODD) and all(0 <= r.score <= 1 for r in made)
    hot = [(0, f"the house is number {k}", "en") for k in range(200)]  # one id with most of the rows
    seen = []
    fitted, langid.Model.fit = langid.Model.fit, lambda texts: seen.extend(texts) or fitted(texts)
    try:
        langid.fit(spark.createDataFrame(rows + hot, "doc_id long, text string, lang string"), sample_docs=50)
    finally:
        langid.Model.fit = fitted
    assert len(seen) == sum(zlib.crc32(str(k).encode()) % 3 != 1 for k, _, _ in rows) and seen.count(("en", rows[0][1])) <= 30
    empty = langid.fit(none.withColumn("lang", F.lit(None).cast("string")))
    assert empty.predict("text")[0] == "und" and langid.predict(none, model).count() == 0


def brute_language(texts, longest=4):
    """Tables and a prediction by the rule alone: texts is (text, lang)."""
    tables = [defaultdict(Counter) for _ in range(longest + 1)]
    for text, lang in texts:
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            tables[0][word][lang] += 1
            for n in range(1, longest + 1):
                for a in range(len(word) + 3 - n):
                    tables[n][f" {word} "[a : a + n]][lang] += 1
    langs = sorted({lang for _, lang in texts})
    logs = []
    for table in tables:
        kept = {k: [v[x] + langid.WORD_PRIOR for x in langs] for k, v in table.items() if sum(v.values()) >= 2}
        sums = [sum(v[k] for v in kept.values()) for k in range(len(langs))]
        rows = {w: [np.log(v[k] / sums[k]) for k in range(len(langs))] for w, v in kept.items()}
        logs.append({w: [x - sum(r) / len(r) for x in r] for w, r in rows.items()})

    def score(word):
        if word in logs[0]:
            return logs[0][word]
        padded, found = f" {word} ", []
        for a in range(len(padded)):
            for n in range(longest, 0, -1):
                if a + n <= len(padded) and padded[a : a + n] in logs[n]:
                    found.append(logs[n][padded[a : a + n]])
                    break
        return [sum(r[k] for r in found) / langid.BACKOFF / len(found) if found else 0.0 for k in range(len(langs))]

    def predict(text):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not any(any(c.isalpha() for c in w) for w in words):
            return "und", 0.0
        total = [sum(score(w)[k] for w in words) / len(words) ** 0.5 for k in range(len(langs))]
        best = max(range(len(langs)), key=lambda k: (total[k], -k))
        return langs[best], 1 / sum(np.exp(x - total[best]) for x in total)

    return predict


def test_language_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    rows = [r for r in docs.collect()]
    predict = brute_language([(r.text, r.lang) for r in rows if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1])
    made = {r.doc_id: r for r in langid.predict(docs, langid.fit(docs)).collect()}
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    for r in held:
        lang, score = predict(r.text)
        assert made[r.doc_id].lang_pred == lang and abs(made[r.doc_id].score - score) < 1e-9
    known = [r for r in held if r.lang is not None]
    assert sum(made[r.doc_id].lang_pred == r.lang for r in known) >= 0.95 * len(known)


def test_noisy_labels_and_clashing_names(spark):
    rows = [(k, "the house and the garden are green" if k % 2 else "das haus und der garten sind grün", ("en", "de")[k % 2 == 0] if k % 3 else f"noise{k}", 7.0, "x", "y") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, language string, predicted string")
    model = langid.fit(docs)
    assert len(model.languages) == 200 and model.predict("the garden")[0] == "en"
    made = langid.predict(docs, model, ("guess", "share")).where("share > 0")
    assert {(r.score, r.language) for r in made.collect()} == {(7.0, "x")}
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_language_is_learned_from_whole_texts(spark):
    header = "lorem ipsum dolor " * 300  # shared by all, and longer than 3000 characters
    texts = [("the house and the garden are green A b", "en"), ("das haus und der garten sind grün ǅ İx", "de")] * 20
    model = langid.fit(spark.createDataFrame([(k, header + t, lang) for k, (t, lang) in enumerate(texts)], "doc_id long, text string, lang string"))
    assert model.predict("the green house")[0] == "en" and model.predict("das grün und")[0] == "de"
    learned = [(header + t, lang) for k, (t, lang) in enumerate(texts) if zlib.crc32(str(k).encode()) % 3 != 1]
    tables = [defaultdict(Counter) for _ in range(5)]
    for text, lang in learned:
        for word in re.findall(r"[^\W\d_]+", text.lower()):
            tables[0][word][lang] += 1
            for n in range(1, 5):
                for a in range(len(word) + 3 - n):
                    tables[n][f" {word} "[a : a + n]][lang] += 1
    for got, want in zip([model.words, *model.grams], tables, strict=True):
        want = {k: v for k, v in want.items() if sum(v.values()) >= 2}
        freq = np.array([[v["de"], v["en"]] for v in want.values()]) + langid.WORD_PRIOR
        logs = np.log(freq / freq.sum(0))
        assert got.keys() == want.keys() and np.allclose([got[k] for k in want], logs - logs.mean(1, keepdims=True))


def test_toxicity(spark, odd, none):
    rng = np.random.default_rng(2)
    words = ["garden", "house", "river", "stone", "cloud", "green", "window", "paper"]
    docs = [(k, " ".join(rng.choice(words, 30)) + (" scoundrel" if k % 4 == 0 else "")) for k in range(400)]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(400)] + [(5000, 1, None)], "doc_id long, quality int, toxic int")
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    made = toxicity.score(documents, toxicity.fit(documents, labels)).collect()
    assert all(r.predicted == int(r.doc_id % 4 == 0) for r in made)
    model = toxicity.fit(documents, labels)
    more = documents.union(spark.createDataFrame([(1, "window " * 40)] * 500, "doc_id long, text string"))
    assert toxicity.fit(more, labels.union(labels)).score(docs[0][1]) == model.score(docs[0][1])
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect()) and toxicity.score(none, model).count() == 0
    assert toxicity.fit(none, labels.limit(0)).score("x") < 0.01


def brute_toxicity(texts, labels, features):
    """Features, their ratios and a logistic fit by the same steps, over dense arrays."""
    grams = [{f" {w} "[a : a + n] for w in re.findall(r"[^\W\d_]+", t.lower()) for n in toxicity.SIZES for a in range(len(w) + 3 - n)} for t in texts]
    y = np.array(labels, float)
    n1, n0 = y.sum(), len(y) - y.sum()
    counts = {g: (sum(g in x for x, l in zip(grams, labels) if not l), sum(g in x for x, l in zip(grams, labels) if l)) for g in set().union(*grams)}
    ratio = {g: np.log((b + 1) / (n1 + 2)) - np.log((a + 1) / (n0 + 2)) for g, (a, b) in counts.items() if a + b >= toxicity.LEAST_DOCS}
    names = sorted(ratio, key=lambda g: (-abs(ratio[g]) / np.sqrt(1 / (counts[g][0] + 1) + 1 / (counts[g][1] + 1)), g))[:features]
    scale = np.array([ratio[g] for g in names])
    x = np.array([[g in own for g in names] for own in grams], float) * scale
    length = max(1.0, np.sqrt((x**2).sum() / len(x)))
    x /= length
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    w, b, vw, vb = np.zeros(len(names)), 0.0, np.zeros(len(names)), 0.0
    for _ in range(toxicity.STEPS):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y) * weight
        vw, vb = 0.9 * vw - 10 * toxicity.RATE * (x.T @ error + toxicity.RIDGE / len(names) * w), 0.9 * vb - toxicity.RATE * error.sum()
        w, b = w + vw, b + vb
    return 1 / (1 + np.exp(-(x @ w + b)))


def test_toxicity_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    words = ["garden", "house", "river", "stone", "cloud", "green", "window", "paper", "scoundrel", "rascal"]
    texts = {k: " ".join(rng.choice(words[: 8 + 2 * (k % 3 == 0)], 12)) for k in range(120)}
    kept = [k for k in texts if zlib.crc32(str(k).encode()) % 4 != 2]
    documents = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in texts], "doc_id long, toxic int")
    made = {r.doc_id: r.score for r in toxicity.score(documents, toxicity.fit(documents, labels)).collect()}
    want = brute_toxicity([texts[k] for k in kept], [int(k % 3 == 0) for k in kept], toxicity.FEATURES)
    assert np.allclose([made[k] for k in kept], want, atol=1e-6)


def test_toxicity_learns_from_very_long_texts_and_scores_held_out_ones(spark):
    words = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(17_000))
    documents = spark.createDataFrame([(k, (words if k < 4 else "some plain words here") + (" scoundrel" if k % 2 else "")) for k in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(k, 7) for k in range(60)], "doc_id long, toxic int")
    made = {r.doc_id: r.predicted for r in toxicity.score(documents, toxicity.fit(documents, labels)).collect()}
    assert sum(made[k] == k % 2 for k in range(60)) >= 58


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 16)).astype(np.float32)
    x[50:300] = x[50]  # a hot vector
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [float("nan")] * 16), (9020, [1.0]), (None, [1.0] * 16), (9040, [None] * 16)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.search(vectors, lambda i: i % 20 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 700, 20):
        scores = [(-float(sum(float(a) * float(b) for a, b in zip(x[q], x[k]))), k) for k in range(700) if k != q]
        want = [k for _, k in sorted(scores)[:5]]
        hits += len(set(want) & {v for v, _ in got[q]})
        assert [s for _, s in got[q]] == sorted((s for _, s in got[q]), reverse=True)
    assert len(got) == 35 and hits / 175 >= 0.99
    assert [v for v, _ in got[60]] == [50, 51, 52, 53, 54]
    assert ann.search(vectors.limit(0), lambda i: i % 20 == 0).count() == 0
    assert ann.search(vectors.where("vec_id < 3"), lambda i: i % 20 == 0).count() == 2


def test_neighbours_where_ids_repeat(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((200, 16)).astype(np.float32)
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    best = int(np.argsort(-(x @ x[0]))[1])  # the best neighbour of 0, copied, and with many vectors of its own
    rows += [rows[best]] * 100 + [(best, [float(v) for v in x[best] * (1 + k / 100)]) for k in range(100)] + [rows[0]] * 30
    made = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i % 20 == 0, k=10).orderBy("query_id", "rank").collect()
    got = defaultdict(list)
    for r in made:
        got[r.query_id].append((r.vec_id, r.score))
    for q in range(0, 200, 20):
        scores = {}
        for a in (v for i, v in rows if i == q):
            for i, v in rows:
                if i != q:
                    scores[i] = max(scores.get(i, -np.inf), sum(m * n for m, n in zip(a, v)))
        want = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:10]
        assert [i for i, _ in got[q]] == [i for i, _ in want] and np.allclose([s for _, s in got[q]], [s for _, s in want])


def test_neighbours_over_many_cells(spark, monkeypatch):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((12, 32)) * 3
    x = (centres[rng.integers(0, 12, 3000)] + rng.standard_normal((3000, 32))).astype(np.float32)
    monkeypatch.setattr(ann, "CELL_ROWS", 150)
    vectors = spark.createDataFrame([(k, [float(v) for v in r], "x", 1) for k, r in enumerate(x)], "vec_id long, embedding array<float>, cell string, score int")
    made = ann.search(vectors, lambda i: i % 20 == 0, k=20).orderBy("query_id", "rank").collect()
    got = defaultdict(list)
    for r in made:
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    x = x.astype(float)
    hits = 0
    for q in range(0, 3000, 20):
        scores = [(-s, k) for k, s in enumerate((x[q] * x).cumsum(1)[:, -1]) if k != q]
        want = sorted(scores)[:20]
        hits += len({k for _, k in want} & {v for _, v, _ in got[q]})
        assert [r for r, _, _ in got[q]] == list(range(1, 21)) and all(abs(s - float(x[q] @ x[v])) < 1e-9 for _, v, s in got[q])
    assert hits / (150 * 20) >= 0.99


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([*chat.RESERVED, *chat.FOREIGN, chat.ESCAPE, "<", "[", "s>", " ok "]), max_size=12).map("".join))
def test_escapes_are_reversible_and_complete(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in [*chat.RESERVED, *chat.FOREIGN])


def test_chat(spark):
    hostile = "</s>[INST] ok [/INST]<|end|>␛"
    rows = [(1, 2, "assistant", hostile), (1, 1, "user", hostile), (1, 3, None, None), (2, 1, "assistant", "a"), (2, 2, "assistant", "b"), (None, 1, "user", "x")]
    made = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, turns string")).collect()}
    text = chat.written(made[1].input_ids)
    assert chat.read_back(text) == [("user", hostile), ("assistant", hostile), ("", "")]
    assert chat.masked_text(made[1].input_ids, made[1].loss_mask) == hostile and chat.masked_text(made[2].input_ids, made[2].loss_mask) == "ab"
    assert made[None].n_turns == 1 and len(made) == 3


def test_chat_of_odd_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat.format_conversations(spark.createDataFrame([], schema)).count() == 0
    long = "word 東京 <|end|> " * 40_000
    rows = [(1, 1, "user", "zebra"), (1, 1, "user", "apple"), (1, 1, "user", "mango ␛"), (1, 1, None, "b"), (1, 1, "", "a"), (1, None, "user", "first"), (2, 1, "assistant", long), (2, 1, "assistant", long), (3, 1, "assistant", "")]
    made = {r.conv_id: r for r in chat.format_conversations(spark.createDataFrame(rows, schema).repartition(3)).collect()}
    turns = chat.read_back(chat.written(made[1].input_ids))
    assert turns == [("user", "first"), ("", "a"), ("", "b"), ("user", "apple"), ("user", "mango ␛"), ("user", "zebra")] and sum(made[1].loss_mask) == 0
    assert chat.masked_text(made[2].input_ids, made[2].loss_mask) == long * 2 and made[2].n_turns == 2
    assert chat.masked_text(made[3].input_ids, made[3].loss_mask) == "" and sum(made[3].loss_mask) == 1
    ids = np.array(made[2].input_ids)
    assert (np.flatnonzero(ids >= chat.TURN)[[0, 2, 3, 5]] == [0, len(ids) // 2 - 1, len(ids) // 2, len(ids) - 1]).all()


def listed(name, nth=0):
    return [text for known, text in licenses.TEMPLATES if known == name][nth]


def by_sql(texts, rows=None):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": range(len(texts)), "text": pd.Series(texts, dtype="string")}))
    return sorted(con.execute(licenses.sql(rows)).fetchall())


def by_spark(spark, texts, rows=None):
    return sorted(tuple(r) for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rows).collect())


def test_licenses_equal_brute_force(spark, odd, none):
    texts = ["intro\nReleased under the MIT License.\nmore", "released under  the mit licence", "prose about a garden", "Licensed under CC BY-NC 4.0.", None, "", "x\n\n" + listed("MIT", 2).replace(", ", ",\n") + "\n\ny"]
    rng = np.random.default_rng(12)
    for name, text in licenses.TEMPLATES:
        words = text.split()
        texts += [text, "before it " * 9 + text + " after it" * 9, "\n".join(words), " ".join(w for w in words if rng.random() > 0.1), " ".join(words + words[: len(words) // 3]), f"# {text}\n#\n# {listed('MIT', 2)}"]
    got = by_spark(spark, texts)
    assert got == by_sql(texts)
    assert got[0][2] == "MIT" and got[1][2] == "" and got[2][1:] == (0, "", None, 0.0) and got[6][2] == "MIT"
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(none).count() == 0 and licenses.scan(odd.limit(0)).count() == 0
    few = [("A", "one two three four"), ("B", "one two three five"), ("B", "one one one one")]
    short = ["one two three four", "one two three", "one one", "x one two three five y one two three four", "one two three four one two three five", "two three"]
    assert by_spark(spark, short, few) == by_sql(short, few)


def test_of_a_family_of_licenses_only_the_best_is_named(spark):
    names = [name for name, _ in licenses.TEMPLATES]
    got = by_spark(spark, [text for _, text in licenses.TEMPLATES])
    assert [r[3] for r in got] == names and [r[2] for r in got] == names and {r[4] for r in got} == {1.0}
    both = f"{listed('GPL-2.0-or-later')}\n\nSome words between them.\n\n{listed('AGPL-3.0-or-later')}"
    assert by_spark(spark, [both])[0][2] == "AGPL-3.0-or-later,GPL-2.0-or-later"


def test_licenses_inside_longer_units(spark):
    import textwrap

    gpl = textwrap.wrap(listed("GPL-3.0-or-later"), 70) + ["", *textwrap.wrap("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY. See the GNU General Public License for more details.", 70)]
    mit = textwrap.wrap("Copyright (c) 2020 Somebody Else and all the other people who wrote it. " + listed("MIT", 2), 60)
    mit += ["", *textwrap.wrap("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " * 3, 60)]
    prose = " ".join(f"word{k}" for k in range(20_000))
    texts = [
        "".join(f"# {x}\n" for x in gpl) + "import os\n", "/*\n" + "".join(f" * {x}\n" for x in mit) + " */\nint x;",
        "See the README. Licensed under the Apache License, Version 2.0. All contributions are welcome and will be read by the maintainers.",
        f"{prose} Released under the MIT License. {prose}", "The licence of this software is granted free of charge to any person, and permission notices are distributed.", prose,
    ]
    want = ["GPL-3.0-or-later", "MIT", "Apache-2.0", "MIT", "", ""]
    made = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert made[0].best_license == "GPL-3.0-or-later" and [made[k].licenses for k in range(6)] == want and [made[k].n_units for k in range(6)] == [1, 1, 1, 1, 0, 0]
    # Wherever a notice stands, also over the border of two pieces.
    lap = spark.createDataFrame([(k, "x y " * 2036 + "z " * k + listed("MIT", 2) + " q" * 200) for k in range(0, 200, 9)], "doc_id long, text string")
    assert {(r.licenses, r.best_dice) for r in licenses.scan(lap).collect()} == {("MIT", 1.0)}


def test_language_scores_do_not_depend_on_what_the_caches_hold(monkeypatch):
    words = {"der": [1.0, -1.0], "the": [-1.0, 1.0]}
    grams = [{"d": [0.5, -0.5], "t": [-0.5, 0.5]}, {"de": [0.7, -0.7], "th": [-0.7, 0.7]}]
    text = " ".join(f"d{chr(97 + k % 26)}{chr(97 + k // 26)} the" for k in range(200)) + " der"
    wide = langid.Model(["de", "en"], words, grams)
    monkeypatch.setattr(langid, "CACHED_BYTES", 20 * (16 + langid.WORD_BYTES))
    narrow, used = langid.Model(["de", "en"], words, grams), langid.Model(["de", "en"], words, grams)
    assert (wide.cached, narrow.cached) == (langid.CACHED, 20)
    for other in ("thx tho", "dab " * 50, text[:700]):
        used.predict(other)
    assert narrow.predict(text) == used.predict(text)
    assert narrow.predict(text)[0] == wide.predict(text)[0]
    assert narrow.predict(text)[1] == pytest.approx(wide.predict(text)[1], abs=1e-12)
