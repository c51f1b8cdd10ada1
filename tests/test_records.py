import datetime
import json

import pytest
from pyspark.sql import functions as F

from veilframe.functions import fixed
from veilframe.operators import declutter, dialogue, egress, memory, report, structure
from veilframe.plans import ingest
from veilframe.sources import documents as sources
from veilframe.sources import knowledge

TODAY = datetime.date(2026, 7, 10)


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")


def test_declutter_keeps_clinical_lines(spark):
    text = "Seite 1 von 3\nAnamnese ohne Befund\nIBAN DE00 1234\nwww.klinik.de\nBitte rufen Sie unter www.klinik.de jederzeit gerne zurück\n\n\n\nEnde"
    assert declutter.declutter(docs(spark, text)).first().text == "Anamnese ohne Befund\nBitte rufen Sie unter www.klinik.de jederzeit gerne zurück\n\nEnde\n"
    assert {r.reason: r.n for r in declutter.statistics(docs(spark, text)).collect()} == {"page": 1, "reqs": 1, "contact": 1}


def test_declutter_repeats(spark):
    line = "Hafenstraße 12 in Hamburg Altona"
    profile = declutter.line_profile(docs(spark, "\n".join([line] * 3 + ["x"] * 4), "\n".join([line] * 2), None)).orderBy("doc_id").collect()
    assert [(r.n_repeated, r.n_repeat, r.n_kept) for r in profile] == [(3, 3, 4), (0, 0, 2), (0, 0, 0)]


def test_prepass_merge_and_metadata(spark):
    text = "Bericht vom 3.2.2024\nProblem: Asthma\nMetformin 500 mg\nHbA1c 6,1"
    reply = json.dumps({"problems": ["Asthma", " Husten "], "document_topic": "Größe der Übersicht", "document_sender": "Dr. Hansen", "sections": {"befund": " ok "}})
    rows = spark.createDataFrame([("a", 1, 1, text, reply), ("a", 2, 2, text, "kein json"), ("a", 3, 3, text, '{"problems": "x"}')], "subject string, seq long, doc_id long, text string, reply string")
    made = structure.named(structure.with_metadata(structure.structured(rows, "reply"), "2026-07-10")).withColumn("markdown", structure.rendered()).orderBy("seq").collect()
    assert made[0].record.problems == ["Asthma", "Husten"] and made[0].record.meds == ["Metformin 500 mg"] and made[0].record.labs == ["HbA1c 6,1"] and made[0].record.timeline == ["Bericht vom 3.2.2024"]
    assert made[0].stem == "2024-02-03_Groesse-der-Uebersicht_unknown-sender" and made[0].date_source == "document"
    assert "## Befund\n\nok" in made[0].markdown and 'topic: "Groesse-der-Uebersicht"' in made[0].markdown
    assert [m.stem for m in made[1:]] == ["2024-02-03_document_unknown-sender", "2024-02-03_document_unknown-sender-2"] and made[2].record.problems == ["Asthma"]


def test_names_avoid_those_in_use(spark):
    rows = spark.createDataFrame([("a", k, k, "2024-01-01", "t", "s") for k in (1, 2, 3)], "subject string, seq long, doc_id long, date string, topic string, sender string")
    used = spark.createDataFrame([("a", "2024-01-01_t_s"), ("a", "2024-01-01_t_s-3")], "subject string, stem string")
    assert [r.stem for r in structure.named(rows, used).orderBy("seq").collect()] == ["2024-01-01_t_s-2", "2024-01-01_t_s-4", "2024-01-01_t_s-5"]


def test_lists_merge_in_order_without_repeats(spark):
    old = spark.createDataFrame([("a", "meds", 1, "x"), ("a", "meds", 2, "y")], "subject string, list string, ord long, item string")
    new = spark.createDataFrame([("a", "meds", "z", 1, 1, 0), ("a", "meds", "x", 1, 1, 1), ("a", "meds", "w", 2, 2, 0)], "subject string, list string, item string, seq long, doc_id long, place int")
    assert [r.item for r in structure.merge_lists(new, old).orderBy("ord").collect()] == ["x", "y", "z", "w"]
    text = "# Meds\n\n- x\n- y z\n" + fixed.NO_ENTRIES
    assert docs(spark, text).select(structure.list_items(F.col("text")).alias("i")).first().i == ["x", "y z"]


def test_ingest_stores_quarantines_and_reuses_tokens(spark):
    rows = spark.createDataFrame(
        [("Patient 1", 1, 1, "Patient: Lotte Beispiel\nProblem: Asthma\nBericht vom 3.2.2024"), ("Patient 1", 2, 2, "Lotte Beispiel geb. in Kiel")],
        "subject string, seq long, doc_id long, text string",
    )
    made = ingest.ingest(rows, ingest.Options(TODAY, synthetic=True))
    stored = made.documents.collect()
    assert [r.doc_id for r in stored] == [1] and "Lotte" not in stored[0].markdown and stored[0].subject == "Patient-1"
    bad = made.quarantined.collect()
    assert [r.doc_id for r in bad] == [2] and {h.pattern for h in bad[0].blocking} == {"DOB_MARKER"}
    assert [r.item for r in made.lists.where("list = 'timeline'").collect()] == ["Bericht vom 3.2.2024 [doc:2024-02-03_document_unknown-sender]"]
    with pytest.raises(RuntimeError):
        ingest.ready(ingest.Options(TODAY))


def test_memory_scopes_before_it_scores_and_erases(spark):
    rows = spark.createDataFrame([("a", "patients/a/1", "t", "asthma husten", 1), ("b", "patients/b/1", "t", "asthma asthma", 2), ("a", "patients/a/2", "t", "", 3)], "subject string, path string, title string, text string, ord long")
    held = memory.index(rows).cache()
    found = memory.search(held, "asthma", "a").collect()
    assert [r.path for r in found][0] == "patients/a/1" and all(r.subject == "a" for r in found)
    again = memory.synced(held, rows.where("subject = 'a'"))
    assert {r.path for r in again.collect()} == {"patients/a/1", "patients/a/2"}
    with pytest.raises(ValueError):
        memory.confined(rows, "patients/../identity_vault/a")
    assert memory.confined(rows, "patients/a/1").count() == 1
    v = rows.select(memory.vector(F.col("text")).alias("v")).collect()
    assert abs(sum(x * x for x in v[0].v) - 1) < 1e-9 and sum(v[2].v) == 0


@pytest.mark.parametrize(("query", "verdict"), [("asthma guideline", "clean"), ("[PATIENT_1] asthma", "token"), ("[1_PATIENT_1]", "token"), ("DOB: x", "raw_pii"), ("a@b.de", "raw_pii"), ("2024-01-01", "clean"), ("2020/2021 report", "clean"), ("call 040 1234 5678", "raw_pii")])
def test_egress(spark, query, verdict):
    assert docs(spark, query).select(egress.verdict(F.col("text")).alias("v")).first().v == verdict
    if verdict == "clean":
        egress.assert_safe(query)
    else:
        with pytest.raises(egress.EgressError):
            egress.assert_safe(query)


def test_report_letters_and_monitor(spark):
    cases = spark.createDataFrame([("a", ["neurologist", "surgeon", "neurologist"], None, [("m", "u")], [])], "subject string, roles array<string>, question string, memory_refs array<struct<source:string,url:string>>, external_refs array<struct<source:string,url:string>>")
    made = report.deterministic(cases, "now").first()
    assert made.chair_summary == "Chair synthesis required across: neurologist, surgeon." and len(made.claims) == 2 and made.model_status == "not_used"
    held = spark.createDataFrame([("a", "[1_PATIENT_2]", "PATIENT", 2, "x", 1), ("a", "[1_PATIENT_1]", "PATIENT", 1, "y", 2)], "subject string, token string, kind string, idx int, value string, ord long")
    asked = spark.createDataFrame([("a", "paper", None, None, None, None, None), ("b", "email", "S", "R", "Kiel", "Frage", "Text")], "subject string, channel string, sender string, recipient string, place string, subject_line string, body string")
    problems = spark.createDataFrame([("a", "- Asthma")], "subject string, body string")
    drafts = {r.subject: r.draft for r in report.letters(asked, held, problems, "10.07.2026").collect()}
    assert "**Ärztliche Einschätzung zu [1_PATIENT_1]**" in drafts["a"] and "[ORT], 10.07.2026" in drafts["a"] and "- Asthma" in drafts["a"]
    assert drafts["b"].startswith("Betreff: Frage\n")
    rows = report.monitor(spark.createDataFrame([("a",), ("z",)], "subject string"), problems).orderBy("patient_id").collect()
    assert [r.latest_timeline for r in rows] == ["- Asthma", ""]


def test_grounded_disagreements(spark):
    said = spark.createDataFrame([(1, 1, "Internist and neurologist differ"), (1, 2, "Internist and surgeon differ"), (1, 3, "internists differ")], "case_id int, ord int, text string")
    claims = spark.createDataFrame([(1, "internist", 1), (1, "neurologist", 2), (1, "surgeon", 0)], "case_id int, role string, n_claims int")
    assert [r.ord for r in report.grounded(said, claims).collect()] == [1]


def test_profiles_and_pending(spark):
    files = spark.createDataFrame([("internist", "p", "x\n#  Internist \n# b")], "role string, path string, content string")
    names = spark.createDataFrame([("internist",), ("other",)], "role string")
    assert {r.role: r.title for r in sources.role_profiles(files, names).collect()} == {"internist": "Internist", "other": "other"}
    inbox = spark.createDataFrame([("b.PDF",), ("a b.txt",), ("c.doc",), ("d.md",)], "name string")
    done = spark.createDataFrame([("d",)], "stem string")
    assert [r.name for r in sources.pending(inbox, done).collect()] == ["a b.txt", "b.PDF"]


def test_pdf_pages_and_ocr(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"eins zwei drei vier\fx")
    (tmp_path / "b.pdf").write_bytes(b"bad")

    def pages_of(content):
        if content == b"bad":
            raise ValueError("broken")
        return content.decode().split("\f")

    pages = sources.pdf_pages(spark, str(tmp_path), pages_of)
    good, bad = pages.where("error is null").drop("error"), pages.where("error is not null")
    assert bad.count() == 1
    ocr = good.where("page = 2").select("path", "page", F.lit("erkannter Text hier").alias("text"))
    made = sources.assembled(sources.with_ocr(good, ocr)).first()
    assert made.text == "eins zwei drei vier\n\nerkannter Text hier" and made.stats.ocr_pages == [2] and made.stats.suspicious_pages == []
    with pytest.raises(Exception, match="pages without text"):
        sources.assembled(sources.with_ocr(good.withColumn("text", F.lit("")), ocr.limit(0))).collect()


def test_knowledge(spark):
    asked = []
    found = knowledge.pubmed("asthma", lambda url, headers: asked.append(url) or '{"esearchresult":{"idlist":["1","2"]}}', limit=1)
    assert found[0]["url"].endswith("/1/") and "term=asthma" in asked[0]
    replies = spark.createDataFrame([("q", '{"data":[{"title":null,"url":"u","year":2020}]}'), ("r", "broken")], "query string, body string")
    assert [(r.title, r.year) for r in knowledge.parsed_semantic_scholar(replies).collect()] == [("Untitled paper", 2020)]
    with pytest.raises(egress.EgressError):
        knowledge.semantic_scholar("[PATIENT_1]", lambda *a: "{}")


def test_dialogue(spark):
    turns = spark.createDataFrame([(1, 1, "system", "be kind"), (1, 2, "user", "hi"), (1, 3, "assistant", None)], "conv_id long, turn long, role string, text string")
    made = dialogue.prompt_fold(turns).first()
    assert made.system == "be kind" and made.prompt == "USER:\nhi\n\nASSISTANT:\n"
    assert dialogue.request_metrics(turns).first().approx_input_units == 2
    events = spark.createDataFrame([(1, 2, "response.output_text.delta", "b", None), (1, 1, "response.output_text.delta", "a", None), (1, 3, "response.completed", None, None)], "reply_id int, ord int, type string, delta string, error string")
    reply = dialogue.joined_deltas(events).first()
    assert reply.content == "ab" and reply.completed
    calls = spark.createDataFrame([(1, 1, 0, "c1", "f", "{"), (1, 2, 0, None, None, "}")], "reply_id int, ord int, idx int, id string, name string, arguments string")
    call = dialogue.tool_calls(calls).first()
    assert (call.id, call.name, call.arguments) == ("c1", "f", "{}")


def test_stream_replay_equals_batch(spark, tmp_path):
    from veilframe.operators import deid
    from veilframe.streaming import inbox

    rows = [("a", k, k, f"Patient: Lotte Beispiel{'x' * (k % 2)}\nKVNR: A12345678{k}") for k in range(4)]
    folder = tmp_path / "in"
    folder.mkdir()
    for k, r in enumerate(rows):
        (folder / f"{k}.json").write_text(json.dumps(dict(zip(("subject", "seq", "doc_id", "text"), r))))
        import os

        os.utime(folder / f"{k}.json", (k + 1, k + 1))
    stream = inbox.rewritten(inbox.inbox(spark, str(folder), files_per_trigger=2), today=TODAY)
    run = stream.writeStream.format("memory").queryName("inbox_out").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r.doc_id: r.text for r in spark.sql("select * from inbox_out").collect()}
    batch = deid.deidentify(spark.createDataFrame(rows, inbox.SCHEMA), today=TODAY)
    assert got == {r.doc_id: r.text for r in batch.collect()} and len(got) == 4
