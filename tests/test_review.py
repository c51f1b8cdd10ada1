"""Review, preview to ingest, retrieval, requests, options and the command line."""

import datetime
import json
import random
import time

import pytest
from pyspark.sql import functions as F

import veilframe
from veilframe import __main__ as command
from veilframe import config
from veilframe.operators import detectors, memory, requests, residue, structure, substrings, vault
from veilframe.plans import ingest, review

DOCS = "subject string, path string, title string, text string, ord long"
VAULT = "subject string, token string, kind string, idx int, value string, ord long"


def answering():
    def reply(system, case):
        known = json.loads(case)
        if "chair" in system:
            return json.dumps({"chair_summary": "done", "disagreements": ["internist vs neurologist: dose", "internist alone"], "open_questions": ["q"]})
        return "```json\n" + json.dumps({"claims": [f"{known['role']}: {sorted(known['patient_memory'])}"]}) + "\n```"

    return reply  # a function of its own, since workers do not import the tests


@pytest.fixture(scope="module")
def case(spark):
    cases = spark.createDataFrame([("p1", ["internist", "neurologist"], "fever"), ("p2", [], None)], "subject string, roles array<string>, question string")
    documents = spark.createDataFrame([("p1", "patients/p1/a.md", "a", "fever and rash", 1), ("p1", "patients/p1/b.md", "b", "calm", 2), ("p2", "patients/p2/c.md", "c", "mail to a@b.org", 1)], DOCS)
    lists = spark.createDataFrame([("p2", "problems", 1, "cough")], "subject string, list string, ord long, item string")
    return cases, documents, lists


def test_model_reports_and_fallbacks(spark, case):
    made = {r.patient_id: r for r in review.reviewed(*case, "now", ask=answering()).collect()}
    one, two = made["p1"], made["p2"]
    assert one.model_status == "used" and one.chair_summary == "done" and one.open_questions == ["q"] and one.disagreements == ["internist vs neurologist: dose"]
    assert one.claims == ["internist: ['patients/p1/a.md', 'patients/p1/b.md']", "neurologist: ['patients/p1/a.md', 'patients/p1/b.md']"]
    # p2's record holds an address, so nothing of it is sent.
    assert (two.model_status, two.model_error, two.claims) == ("fallback", "ResidueError", ["internist: review p2 for overall differential and primary-care coordination."])
    for bad, error in ((lambda s, c: "no json", "JSONDecodeError"), (lambda s, c: "[]", "ValueError"), (lambda s, c: '{"claims": "x"}', "ValueError"), (lambda s, c: 1 / 0, "ZeroDivisionError")):
        r = review.reviewed(*case, "now", ask=bad).where("patient_id = 'p1'").first()
        assert (r.model_status, r.model_error, r.recommended_next_step) == ("fallback", error, "Review this report with a licensed physician.")
    sent = {r.subject: len(r.blocking) for r in review.regated(review.retrieved(case[0].select("subject", F.lit("mail").alias("query")), case[1]), None).where("path like '%c.md'").collect()}
    assert sent == {"p2": 1}


def test_accepted_residue_is_sent(spark, case):
    cases, documents, lists = case
    front = documents.withColumn("text", F.concat(F.lit('accepted_residue: ["EMAIL"]\n'), "text"))
    assert review.reviewed(cases, front, lists, "now", ask=answering()).where("patient_id = 'p2'").first().model_status == "used"


def test_reports_without_a_model(spark, case):
    made = {r.patient_id: json.loads(r.report) for r in review.as_json(review.reviewed(*case, "now")).collect()}
    assert made["p1"]["model_status"] == "not_used" and made["p2"]["roles"] == ["internist"] and made["p1"]["open_questions"] == ["fever"]
    assert [x["url"] for x in made["p2"]["evidence_refs"]] == ["patients/p2/c.md", "problems.md"]


def test_search_never_crosses_subjects(spark, case):
    asked = spark.createDataFrame([("p2", "fever and rash")], "subject string, query string")
    assert {r.subject for r in review.retrieved(asked, case[1]).collect()} == {"p2"}


def test_index_is_built_if_missing(spark, case, tmp_path):
    where = f"{tmp_path}/index"
    assert memory.opened(spark, where, case[1]).count() == 3
    changed = case[1].withColumn("text", F.when(F.col("subject") == "p1", "new text").otherwise(F.col("text")))
    assert sorted(r.source_sha256 for r in memory.opened(spark, where, changed).collect()) == sorted(r.h for r in changed.select(F.sha2("text", 256).alias("h")).collect())
    assert memory.opened(spark, where, case[1].where("subject = 'p2'")).count() == 1
    assert [r.subject for r in memory.subjects(case[1]).collect()] == ["p1", "p2"]


def test_preview_becomes_a_document(spark):
    held = spark.createDataFrame([("p7", "[7_PATIENT_1]", "PATIENT", 1, "Ada", 1)], VAULT)
    previews = spark.createDataFrame([("p7", 1, 1, "preview-2024.03-05", "Seen [PATIENT_1] and [PATIENT_2] at 12:00 with 1234567", ["digit_run"])], "subject string, seq long, doc_id long, stem string, text string, accepted array<string>")
    mine = spark.createDataFrame([("p7", "[PATIENT_1]", "Ada", 1), ("p7", "[PATIENT_2]", "Bob", 2)], "subject string, token string, value string, ord long")
    options = ingest.Options(datetime.date(2026, 7, 10), reviewed=True)
    made = ingest.from_preview(previews, mine, held, options)
    row = made.documents.first()
    assert "[7_PATIENT_1] and [7_PATIENT_2]" in row.text and (row.date, row.date_source) == ("2024-03-05", "filename") and 'accepted_residue: ["DIGIT_RUN"]' in row.markdown
    assert [(r.token, r.value, r.ord) for r in made.vault.collect()] == [("[7_PATIENT_2]", "Bob", 2)]
    blocked = ingest.from_preview(previews.withColumn("accepted", F.lit(None).cast("array<string>")), mine, held, options)
    assert blocked.documents.count() == 0 and [h.pattern for h in blocked.quarantined.first().blocking] == ["DIGIT_RUN"]
    with pytest.raises(RuntimeError):
        ingest.from_preview(previews, mine, held, ingest.Options(datetime.date(2026, 7, 10)))
    with pytest.raises(ValueError, match="empty"):
        ingest.from_preview(previews.withColumn("text", F.lit(" ")), mine, held, options)


def test_conflicting_tokens_are_an_error_that_names_no_value(spark, monkeypatch):
    held = spark.createDataFrame([("p7", "[7_PATIENT_1]", "PATIENT", 1, "Ada", 1)], VAULT)
    mapping = spark.createDataFrame([("p7", "[PATIENT_1]", "[7_PATIENT_1]", "Eve", 1)], "subject string, token string, new_token string, value string, ord long")
    monkeypatch.setattr(vault, "reconcile", lambda *a: mapping)
    with pytest.raises(vault.ConflictError) as raised:
        vault.merged(held, held, held, F.lit("7"))
    assert "[7_PATIENT_1]" in str(raised.value) and "Eve" not in str(raised.value) and "Ada" not in str(raised.value)


def test_leak_counts_over_many_blocks(spark):
    held = spark.createDataFrame([(None if k % 2 else "s", f"value{k:04d}") for k in range(300)] + [("s", "value0000"), ("t", "")], "subject string, value string")
    rows = [("s", 1, " ".join(f"value{k:04d}" for k in range(20))), (None, 2, "value0001x value0002"), ("u", 3, "value0000"), ("s", 4, None), ("s", 1, "value0298")]
    made = vault.leak_counts(held, spark.createDataFrame(rows, "subject string, doc_id long, text string"), block=7)
    assert sorted((r.doc_id, r.n_leaks) for r in made.collect()) == [(1, 1), (1, 10), (2, 1), (3, 0), (4, 0)]


def test_substring_counts_equal_brute_force(monkeypatch):
    rng = random.Random(3)
    for _ in range(100):
        monkeypatch.setattr(substrings, "PIECE", rng.choice([1, 7, 64, 1 << 17]))
        letters = rng.choice(["ab", "abc", "aé🙂\n", "the quick"])
        words = lambda most, many: ["".join(rng.choices(letters, k=rng.randint(least, most))) for _ in range(rng.randint(0, many))]
        least = 1
        values = set(words(rng.choice([3, 9, 40]), 30))
        least = 0
        texts = words(rng.choice([5, 50, 300]), 8)
        index = substrings.Index(**substrings.fingerprints([v.encode() for v in values]))
        assert index.counts([t.encode() for t in texts]) == [sum(v in t for v in values) for t in texts]


def test_leak_counts_of_a_large_subject(spark):
    """150 million pairs of a document and a value, over parted texts and values."""
    held = spark.range(30_000).selectExpr("'s' as subject", "concat('Moorweg ', id, ' in Nordhafen') as value")
    rows = spark.range(5000).selectExpr("'s' as subject", "id as doc_id", "concat(repeat('und dann kam er von der Moorweg ', 20), 'Moorweg ', id, ' in Nordhafen, Moorweg ', id + 29990, ' in Nordhafen') as text")
    began = time.monotonic()
    made = {r.doc_id: r.n_leaks for r in vault.leak_counts(held, rows, block=20_000, part=1 << 20).collect()}
    assert made == {k: 2 if k < 10 else 1 for k in range(5000)}
    assert time.monotonic() - began < 30


def test_structuring_asks_twice_and_falls_back(spark):
    rows = spark.createDataFrame([("Problem: cough",)], "text string")
    calls = []

    def second(prompt, body):
        calls.append(body)
        return '{"problems": ["flu"]}' if len(calls) > 1 else "no json"

    assert structure.structured(structure.asked(rows, second), "reply").first().record.problems == ["cough", "flu"]
    assert structure.structured(structure.asked(rows, lambda p, b: '{"problems": "flu"}'), "reply").first().record.problems == ["cough"]


def test_prompted_detector_and_registry():
    seen = []

    def fetch(body):
        seen.append(body)
        return {"entities": [{"kind": "PERSON", "value": "Ada"}, {"kind": "PERSON", "value": "mutter"}]}

    found = detectors.prompted(fetch, "m", 10, 2)("Ada was here today")
    assert found == [("PERSON", "Ada")] and len(seen) == 2 and seen[0]["options"] == {"temperature": 0} and seen[0]["format"]["required"] == ["entities"]
    with pytest.raises(ValueError):
        detectors.prompted(fetch, "m", 10, 10)
    assert detectors.configured(config.Detection()) is None
    assert detectors.configured(config.Detection(prompted_model="m"), fetch=fetch)("Ada") == [("PERSON", "Ada")]
    with pytest.raises(RuntimeError):
        detectors.configured(config.Detection(zero_shot_model="m"))
    both = detectors.configured(config.Detection(prompted_model="m", zero_shot_model="z"), fetch=fetch, predict=lambda t, labels, threshold: [{"label": "person", "text": "Ada"}, {"label": "email", "text": "a@b.c"}])
    assert both("Ada a@b.c") == [("PERSON", "Ada"), ("EMAIL", "a@b.c")]


def test_detection_as_columns(spark):
    rows = spark.createDataFrame([('{"entities": [{"kind": "PERSON", "value": "Ada"}]}',), ('```json\n[{"kind": "EMAIL", "value": "a@b.c"}]\n```',), ('{"kind": "PHONE", "value": "1"}',), ("nonsense",)], "reply string")
    got = [r.e for r in rows.select(detectors.reply_column(F.col("reply")).alias("e")).collect()]
    assert [x and [(y.kind, y.value) for y in x] for x in got] == [[("PERSON", "Ada")], [("EMAIL", "a@b.c")], [("PHONE", "1")], None]
    texts = spark.createDataFrame([("Ada",), (None,)], "text string")
    assert [[(e.kind, e.value) for e in r.entities] for r in detectors.detect(texts, detectors.pattern_detector("PERSON", "Ada")).collect()] == [[("PERSON", "Ada")], []]


def test_requests():
    made = requests.request([{"role": "user", "content": "x"}], "be brief", json_reply=True, max_tokens=10)
    assert made["max_tokens"] == 8192 and not made["stream"] and made["messages"][0] == {"role": "system", "content": "be brief"} and "tools" not in made
    assert requests.request([], "s", [{"a": 1}])["tools"] == [{"a": 1}] and requests.request([], "s")["stream"]
    assert [requests.wait(k, 5, 180, 0) for k in (1, 2, 3, 9, 99)] == [5, 10, 20, 180, 180]
    assert 5 <= requests.wait(1, rng=random.Random(1)) <= 7.5
    tools = requests.tools_as_responses([{"function": {"name": "f", "description": "d", "strict": 1}}, {}])
    assert tools == [{"type": "function", "name": "f", "parameters": {"type": "object", "properties": {}}, "description": "d", "strict": True}, {"type": "function", "name": None, "parameters": {"type": "object", "properties": {}}}]


def test_calls_are_repeated_within_a_deadline():
    def sender(*outcomes):
        left = list(outcomes)

        def send(made, seconds):
            outcome = left.pop(0)
            if isinstance(outcome, Exception):
                raise outcome
            return outcome

        return send

    go = lambda *outcomes, **options: requests.call(sender(*outcomes), {}, sleep=lambda s: None, **options)
    assert go(requests.Refused(503), ConnectionError(), requests.Refused(429), "yes") == "yes"
    assert go(requests.Refused(401), "yes", refresh=lambda: None) == "yes"
    for outcomes, error in (((requests.Refused(400),), requests.Refused), ((requests.Refused(401),), requests.Refused), ((requests.Refused(500),) * 4, requests.Refused), ((ConnectionError(),) * 4, ConnectionError)):
        with pytest.raises(error):
            go(*outcomes)
    with pytest.raises(requests.Refused):
        go(requests.Refused(401), requests.Refused(401), refresh=lambda: None)
    times = iter([0.0, 0.0, 130.0, 131.0, 132.0, 133.0])
    with pytest.raises(requests.Deadline):
        go(requests.Refused(503), "late", clock=lambda: next(times))


def test_streams_that_stall_are_errors():
    assert list(requests.watched(iter([1, 2, 3]))) == [1, 2, 3]

    def stalls():
        yield 1
        time.sleep(5)

    began = time.monotonic()
    with pytest.raises(requests.Deadline):
        list(requests.watched(stalls(), silence_s=0.2))
    assert time.monotonic() - began < 2

    def breaks():
        yield 1
        raise OSError("gone")

    with pytest.raises(OSError):
        list(requests.watched(breaks()))

    def drips():
        while True:
            time.sleep(0.05)
            yield 1

    with pytest.raises(requests.Deadline):
        list(requests.watched(drips(), deadline_s=0.4))


def test_options(tmp_path):
    path = tmp_path / "options.json"
    path.write_text(json.dumps({"runtime": {"allow_real_documents": True}, "detection": {"chunk_size": 100}}))
    made = config.load(str(path))
    assert made.runtime.allow_real_documents and made.detection.chunk_size == 100 and made.detection.residue["EMAIL"] == "block"
    assert config.validated(None) == config.Config()
    for bad in ({"other": {}}, {"runtime": {"allow": 1}}):
        with pytest.raises(ValueError):
            config.validated(bad)


def test_exports():
    assert all(callable(getattr(veilframe, name)) for name in veilframe.__all__) and len(veilframe.__all__) >= 22
    with pytest.raises(AttributeError):
        veilframe.nothing


def test_nothing_that_is_searched_holds_vault_data(spark):
    """What retrieval and reviews may return has no column of the vault's, and no value of it."""
    rows = spark.createDataFrame([("p1", 1, 1, "Patient: Ada Lovelace\nsehr müde")], "subject string, seq long, doc_id long, text string")
    made = ingest.ingest(rows, ingest.Options(datetime.date(2026, 7, 10), synthetic=True))
    assert {"value", "token", "new_tokens"}.isdisjoint(set(made.lists.columns) | set(made.quarantined.columns))
    assert "Lovelace" not in made.documents.first().markdown and made.vault.first().value == "Ada Lovelace"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(spark.__class__, "stop", lambda self: None)
    docs = f"{tmp_path}/docs"
    spark.createDataFrame([("p1", 1, 1, "patients/p1/a.md", "a", "Patient: Ada Lovelace\nProblem: fever\nvom 05.03.2024")], "subject string, seq long, doc_id long, path string, title string, text string").write.parquet(docs)
    out = f"{tmp_path}/out"
    command.main(["ingest", docs, out, "--synthetic", "--today", "2026-07-10"])
    command.main(["preview", docs, out, "--synthetic"])
    report = json.loads(spark.read.parquet(f"{out}/preview_reports").first().report)
    assert report["blocked"] is False and set(report["declutter"]) == {"page", "reqs", "contact", "repeat"} and "Lovelace" not in json.dumps(report)
    lists, held = f"{out}/records/lists", f"{out}/identity_vault"
    command.main(["review", docs, lists, out, "--question", "what now", "--today", "2026-07-10"])
    assert json.loads(spark.read.json(f"{out}/reports").first().report)["open_questions"] == ["what now"]
    capsys.readouterr()
    command.main(["letter", docs, held, lists, "p1", "--today", "2026-07-10"])
    draft = capsys.readouterr().out
    assert "10.07.2026" in draft and "Lovelace" not in draft and "- fever" in draft
    spark.createDataFrame([("p1", draft)], "subject string, draft string").write.parquet(f"{tmp_path}/drafts")
    command.main(["letter-render", f"{tmp_path}/drafts", held])
    assert "Ada Lovelace" in capsys.readouterr().out
    command.main(["search", docs, "p1", "fever"])
    command.main(["monitor", docs, lists])
    command.main(["residue", docs])
    assert "manual_or_scheduled" in capsys.readouterr().out
    with pytest.raises(RuntimeError):
        command.main(["ingest", docs, f"{out}2"])
