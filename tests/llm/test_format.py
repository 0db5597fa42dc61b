"""Chat formatting, secret scans, the pipeline and the registry."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pyarrow as pa

import __spark_entry__ as entry
import corpus_pipeline
from conftest import SF0001
from kestrel.llm import chat_format as cf
from kestrel.llm import secrets
from kestrel.llm.common import read

from .helpers import empty_docs, odd_docs


def conversations(spark):
    rng = random.Random(2)
    parts = ["<", "|", ">", "\\", "</s>", "<s>", "[INST]", "[/INST]", "s", "a", "/", "\n", "[", "<|a|>", "é", "INST]", " ", "$1", "</", "<<SYS>>", "😀"]
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 0, "user", None), (3, 0, "assistant", ""), (4, None, None, "\\"), (5, 0, "we|ir|>d\\", "<|"), (5, 1, "assistant", "\\\\<\\|é"), (None, 0, "user", "n"), (None, 0, "assistant", "z"), (7, 1, "user", "d"), (7, 1, "user", "d")]
    for i in range(200):
        rows += [(100 + i, t, rng.choice(["user", "assistant", "system"]), "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))) for t in range(rng.randint(1, 6))]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def turns_of(rows):
    out = defaultdict(list)
    for c, t, role, text in rows:
        out[c].append((t is not None, t or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(v)] for c, v in out.items()}


def test_round_trip(spark):
    rows, df = conversations(spark)
    back = {r.conv_id: r for r in cf.read_back(cf.prefix_targets(df)).collect()}
    want = turns_of(rows)
    assert set(back) == set(want)
    for c, v in want.items():
        assert [(t.role, t.text) for t in back[c].turns] == v
        assert back[c].trained == [text for role, text in v if role == "assistant"]


def test_each_reply_is_an_example_after_all_before_it(spark):
    rows, df = conversations(spark)
    want = turns_of(rows)
    by = defaultdict(list)
    for r in cf.prefix_targets(df).orderBy("example").collect():
        assert r.text == r.context + r.target and (r.loss_start, r.loss_end) == (len(r.context), len(r.text))
        by[r.conv_id].append(r)
    for c, v in want.items():
        replies = [i for i, (role, _) in enumerate(v) if role == "assistant"]
        trained = [r for r in by[c] if r.target]
        assert len(trained) == len(replies)
        for r, i in zip(trained, replies):
            assert len(re.findall(cf.TURN, r.context)) == i


def test_no_control_string_is_left_in_a_text(spark):
    _, df = conversations(spark)
    for r in cf.prefix_targets(df).collect():
        for _, body in re.findall(cf.TURN, r.text):
            assert not re.search("|".join(cf.CONTROL), body)


def test_query_digests(spark):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in read(spark, SF0001, "conversations").collect()]
    want = turns_of([*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")])
    got = {r.conv_id: r for r in cf.op9_chat_format(spark, SF0001).collect()}
    assert set(got) == set(want)
    for c, v in want.items():
        trained = "".join(t for role, t in v if role == "assistant")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert (got[c].n_turns, got[c].loss_chars) == (len(v), len(trained))
        assert (got[c].turns_sha256, got[c].loss_sha256) == (digest("".join(f"{r}\n{t}\n" for r, t in v)), digest(trained))


def test_main_path_is_native(spark):
    plan = cf.op9_chat_format(spark, SF0001)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert cf.prefix_targets(none).count() == 0


# secrets


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(found)]


def test_base_spans_match_the_patterns():
    rng = random.Random(5)
    parts = ["password", "PASSWD", "Secret", "token", "api_key", "APIKEY", "ſecret", '"', "'", " ", "  ", ":", "=", "a1B2c3D4", "deadbeef" * 4, "AKIA", "ABCDEFGH0123", "é", "\n", "x/y+z=.-_", "0f" * 20, "😀", "AKIAAKIA"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + [None, ""]
    for text, spans in zip(texts, secrets.scan_chunk(pa.array(texts))):
        assert [s for s in spans if s[0] != "entropy"] == base_spans(text or "")
        assert all(0 <= a < b <= len(text) for _, a, b in spans)


def test_incremental_entropy_matches_direct():
    rng = random.Random(6)
    for _ in range(300):
        run = "".join(rng.choice("0123456789abcdefGHJKLMNPQRSTUVWXYZ+/"[: rng.choice([4, 12, 36])]) for _ in range(rng.randint(18, 60)))
        kind, w = secrets.char_class(run), secrets.WINDOW
        hits = set()
        for i in range(len(run) - w + 1):
            c = Counter(run[i : i + w])
            if kind and -sum(x / w * math.log2(x / w) for x in c.values()) >= secrets.LEAST_BITS[kind] - 1e-9:
                hits |= set(range(i, i + w))
        assert hits == {k for a, b in secrets.entropy_spans(run) for k in range(a, b)}


def test_entropy_adds_spans_and_the_allow_list_suppresses():
    secret, uuid = "q7Zx1Lm9Kp3Vb8Nw2Td5Rs6Yc4", "123e4567-e89b-12d3-a456-426614174000"
    texts = pa.array([f"see {secret} é", f"é {secret}", f"id {uuid}", "a-long-name-of-words-joined-together", "1234567890123456789012345", f"token = {secret}", "aaaaaaaaaaaaaaaaaaaaaaaa1"])
    found = secrets.scan_chunk(texts)
    assert found[0] == [("entropy", 4, 4 + len(secret))] and found[1] == [("entropy", 2, 2 + len(secret))]
    assert found[2] == found[3] == found[4] == found[6] == []
    assert found[5] == [("assign", 0, 8 + len(secret))]
    assert secrets.scan_chunk(pa.array([secret]), allow=("q7Z.*",)) == [[]]


def test_scan_and_redact_odd_rows(spark):
    docs = odd_docs(spark)
    assert secrets.scan(docs).count() == docs.count() and secrets.scan(empty_docs(spark)).count() == 0
    assert secrets.redact(docs).dtypes == docs.dtypes
    one = spark.createDataFrame([(1, 'x password = "hunter2hunter2" y'), (2, None)], "doc_id long, text string")
    assert [r.text for r in secrets.redact(one).orderBy("doc_id").collect()] == ['x [SECRET]" y', None]


def test_query_of_secrets(spark):
    got = {r.doc_id: r for r in entry.queries()["op5_secret_scan"](spark, SF0001).collect()}
    for d in read(spark, SF0001, "documents").collect():
        want = base_spans(d.text)
        r = got[d.doc_id]
        n = Counter(k for k, _, _ in want)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


# pipeline and registry


def test_pipeline_stages(spark):
    docs = read(spark, SF0001, "documents")
    columns, ids = docs.dtypes, {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, SF0001), "test")
        assert docs.dtypes == columns, name
        assert {r.doc_id for r in docs.collect()} <= ids
        ids = {r.doc_id for r in docs.collect()}
    assert not any(base_spans(r.text) for r in docs.collect())
    packed = corpus_pipeline.packing(spark, docs, SF0001).collect()
    assert {r.doc_id for r in packed} == ids
    assert entry.queries()["pipeline"].__wrapped__ is corpus_pipeline.run


def test_stages_of_an_empty_table(spark):
    docs = empty_docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF0001).count() == 0


def test_every_operator_is_registered():
    names = [n for n in entry.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
