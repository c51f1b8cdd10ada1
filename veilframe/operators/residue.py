"""Residue gate: what de-identification may have missed, as (line, pattern, action) hits of a document.

A document's lines are an array in its row; a line's surroundings are slices of it, so hits need no shuffle.
Every rule is first asked once of the whole text: a document that no rule can match pays for nothing else, and in the others only the
rules that can match are asked of each line. Only lines that a rule matches pay for their surroundings.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import computed, has, java, let, lines, strip


class PolicyError(ValueError):
    pass


class ResidueError(RuntimeError):
    """Names the patterns and their lines, never the content."""


def merged_policy(policy: dict[str, str] | None = None) -> dict[str, str]:
    merged = fixed.POLICY | {str(k).upper(): str(v).lower() for k, v in (policy or {}).items()}
    for name, action in merged.items():
        if action not in fixed.ACTIONS:
            raise PolicyError(f"unknown action for {name}: {action}")
    return merged


def around(all_lines: Column, i: Column, before: int, after: int) -> Column:
    """Lines i - before to i + after (0-based, clipped), joined."""
    first = F.greatest(i - before, F.lit(0))
    return F.array_join(F.slice(all_lines, first + 1, F.greatest(i + after + 1 - first, F.lit(0))), "\n")


def is_recipient(all_lines: Column, i: Column) -> Column:
    """A line of a recipient's block: a salutation line among the three before, or a patient token nearby without an affiliation."""
    first = F.greatest(i - 3, F.lit(0))
    salutation = F.exists(F.slice(all_lines, first + 1, i - first), lambda x: has(x, fixed.RECIPIENT))
    return salutation | (has(around(all_lines, i, 2, 0), fixed.PATIENT_TOKEN) & ~has(around(all_lines, i, 4, 0), fixed.INSTITUTION))


def is_institutional(all_lines: Column, i: Column) -> Column:
    """An institution's address, telephone or number rather than a person's."""
    nearby = around(all_lines, i, 4, 4)
    return ~is_recipient(all_lines, i) & (has(F.get(all_lines, i), fixed.LETTERHEAD) | (~has(nearby, fixed.PRIVATE) & has(nearby, fixed.INSTITUTION)))


def _adjacent_name(all_lines: Column, line: Column, i: Column) -> Column:
    """A name-like word glued to a patient token, or alone on a line beside a bare token."""
    garbage = F.regexp_count(line, F.lit(java(fixed.OCR_GARBAGE))) >= 2
    following = F.get(F.filter(F.slice(all_lines, i + 2, F.size(all_lines)), lambda x: strip(x) != ""), F.lit(0))
    glued = has(line, fixed.TOKEN_THEN_NAME) & (garbage | F.coalesce(has(following, fixed.ROLE_LINE), F.lit(False)))
    bare = lambda k: F.coalesce(F.when(k >= 0, has(F.get(all_lines, k), fixed.BARE_TOKEN)), F.lit(False))
    word = strip(line)
    ordinary = F.lower(word).isin(fixed.HEADINGS) | ((F.length(word) >= 13) & ~word.contains("-"))
    return glued | (has(line, fixed.LONE_WORD) & ~ordinary & (bare(i - 1) | bare(i + 1)))


def _holds(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words))


def _traces(text: Column) -> Column:
    """A flag for each rule: can it match a line of the text? By plain words that it needs, so it is true too often, never too seldom.

    Lower case finds every spelling of these words but those with a character that only case folding makes a letter of them; a text
    with such a one is asked for everything.
    """

    def flags(known: Column) -> Column:
        low, digit, born, token = (known[x] for x in ("low", "digit", "born", "token"))
        any_of = lambda *words: _holds(low, words)
        ends = [end.replace("\\.?", dot) + blank for end in fixed.STREET_END.split("|") for dot in ("", ".") for blank in " \t"]
        titled = [word + after for word in ("dr", "prof") for after in ". \t"]
        needed = {
            "CORRUPTED_TOKEN": any_of("[", "]"), "DOB": digit & born, "PERSON_HEADER": any_of("patienten", "seite"), "STREET": digit & any_of(*dict.fromkeys(ends)),
            "PLZ_CITY": digit & has(low, (r"\d{2}[ \t]?\d{3}[ \t]", "")), "PHONE": digit & any_of("tel", "fax"), "EMAIL": any_of("@"), "DIGIT_RUN": digit & has(low, (r"\d{6}", "")),
            "KVNR": digit & low.rlike("[a-z][0-9]{9}"), "CASE_NUMBER": any_of("fall-nr", "fallnummer", "patienten-nr") | (any_of("pat", "aufn") & low.rlike(r"(?U)(?:pat|aufn)\.?\s*-?\s*nr")),
            "NAME_CUE": any_of("arzt", "ärztin", "frau", "herr", "geehrte", "fr.", "hr.", "gez.", *titled),
            "DOB_MARKER": born, "PARTIAL_NAME": any_of("*age") | (born & token), "TOKEN_ADJACENT_NAME": token | any_of("addr_"),
        }
        return F.struct(*((known["odd"] | test).alias(name) for name, test in needed.items()))

    def common(low: Column) -> Column:
        return F.struct(low.alias("low"), has(low, (r"\d", "")).alias("digit"), low.contains("geb").alias("born"), low.contains("patient_").alias("token"), _holds(low, ("\u017f", "\u212a", "\u0131", "i\u0307")).alias("odd"))

    return let(let(F.lower(text), common), flags)


def _rules(all_lines: Column, line: Column, i: Column, retained: Column, possible: Column) -> dict[str, Column]:
    """Whether each rule reports the line, in the order of reporting."""
    found = {name: possible[name] & has(line, pattern) for name, pattern in fixed.RESIDUE.items()}
    for name in fixed.EXEMPT_BY_PLACE:
        found[name] = found[name] & ~is_institutional(all_lines, i)
    mailbox = strip(F.regexp_extract(line, java((fixed.MAIL, "i")), 0))
    found["EMAIL"] = found["EMAIL"] & ~F.array_contains(retained, mailbox)
    found["DIGIT_RUN"] = found["DIGIT_RUN"] & ~(has(line, fixed.CONTACT_OR_NUMBER) & is_institutional(all_lines, i))
    marker, where = has(line, fixed.BIRTH_MARKER), F.regexp_instr(line, F.lit(java(fixed.BIRTH_MARKER)))
    end = where + F.length(F.regexp_extract(line, java(fixed.BIRTH_MARKER), 0))
    found["DOB_MARKER"] = possible["DOB_MARKER"] & marker & ~has(F.substr(line, end.cast("int"), F.lit(24)), fixed.SAFE_AFTER_BIRTH)
    before = F.substr(line, F.lit(1), F.greatest(F.regexp_instr(line, F.lit(java(fixed.SWEPT_BIRTH))) - 1, F.lit(0)).cast("int"))
    swept = has(line, fixed.SWEPT_BIRTH) & has(F.regexp_replace(before, java(fixed.ANY_TOKEN), ""), fixed.CAPITALISED)
    found["PARTIAL_NAME"] = possible["PARTIAL_NAME"] & ((marker & has(line, fixed.PARTIAL_NAME)) | swept)
    found["TOKEN_ADJACENT_NAME"] = possible["TOKEN_ADJACENT_NAME"] & _adjacent_name(all_lines, line, i)
    return found


def hits(text: Column, policy: dict[str, str] | None = None, retained: Column | None = None, overrides: Column | None = None) -> Column:
    """The text's hits, array of (line, pattern, action).

    retained: array of institutional mailboxes; overrides: array of rule names that only report in this row.
    """
    actions = merged_policy(policy)
    retained = F.array().cast("array<string>") if retained is None else F.coalesce(retained, F.array().cast("array<string>"))
    overrides = F.array().cast("array<string>") if overrides is None else F.coalesce(overrides, F.array().cast("array<string>"))
    action = lambda name: F.when(F.array_contains(overrides, name), "report").otherwise(actions[name])
    hit = lambda number, name: F.struct(number.cast("int").alias("line"), F.lit(name).alias("pattern"), action(name).alias("action"))

    names = [name for name in fixed.POLICY if actions[name] != "ignore"]

    def of_line(all_lines: Column, line: Column, i: Column, possible: Column) -> Column:
        rules = _rules(all_lines, line, i, retained, possible)
        return F.filter(F.array(*(F.when(rules[name], hit(i + 1, name)) for name in names)), lambda x: x.isNotNull())

    def of_lines(possible: Column) -> Column:
        found = let(lines(text), lambda all_lines: F.flatten(F.transform(all_lines, lambda line, i: of_line(all_lines, line, i, possible))))
        any_rule = F.lit(False)
        for name in names:
            any_rule = any_rule | possible[name]
        return F.when(any_rule, found).otherwise(nothing)

    text = F.coalesce(text, F.lit(""))
    nothing = F.array().cast("array<struct<line:int,pattern:string,action:string>>")
    found = let(_traces(text), of_lines) if names else nothing
    if actions["CORRUPTED_TOKEN"] != "ignore":
        uneven = F.regexp_count(text, F.lit(r"\[")) != F.regexp_count(text, F.lit(r"\]"))
        found = F.concat(found, F.when(uneven, F.array(hit(F.lit(1), "CORRUPTED_TOKEN"))).otherwise(nothing))
    return found


def report(documents: DataFrame, policy: dict[str, str] | None = None, retained: str | None = None) -> DataFrame:
    """(doc_id, line, pattern, action), a row per hit."""
    found = hits(F.col("text"), policy, F.col(retained) if retained else None)
    return documents.select("doc_id", F.explode(found).alias("h")).select("doc_id", "h.*")


def gate(documents: DataFrame, policy: dict[str, str] | None = None, retained: str | None = None, overrides: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(passed, quarantined): the second with the blocking hits, without content in them."""
    judged = computed(documents, "residue", hits(F.col("text"), policy, F.col(retained) if retained else None, F.col(overrides) if overrides else None))
    blocking = F.filter("residue", lambda h: h.action == "block")
    judged = judged.withColumn("blocking", blocking)
    return judged.where(F.size("blocking") == 0).drop("blocking"), judged.where(F.size("blocking") > 0)


def assert_clean(documents: DataFrame, policy: dict[str, str] | None = None, retained: str | None = None) -> None:
    """Raise for the first documents with a blocking hit: at most ten are named."""
    bad = gate(documents, policy, retained)[1].select("doc_id", "blocking").limit(10).collect()
    if bad:
        told = "; ".join(f"document {r.doc_id}: " + ", ".join(f"{h.pattern} line {h.line}" for h in r.blocking) for r in bad)
        raise ResidueError(f"residue blocks: {told}")


def accepted(text: Column) -> Column:
    """Rules that a stored document's front matter accepts, upper case; anything but a JSON list of strings accepts none."""
    listed = F.regexp_extract(text, r"(?m)^accepted_residue: (\[.*\])$", 1)
    return F.transform(F.coalesce(F.from_json(listed, "array<string>"), F.array().cast("array<string>")), F.upper)



def policy_summary(documents: DataFrame, policy: dict[str, str] | None = None) -> DataFrame:
    """(pattern, action, n_hits, n_docs) over all rules, zero counts kept."""
    spark = documents.sparkSession
    rules = spark.createDataFrame(sorted(merged_policy(policy).items()), "pattern string, action string")
    per_doc = report(documents, policy).groupBy("doc_id", "pattern").agg(F.count("*").alias("n"))
    counted = per_doc.groupBy("pattern").agg(F.sum("n").alias("n_hits"), F.count("*").alias("n_docs"))
    return rules.join(counted, "pattern", "left").select("pattern", "action", F.coalesce("n_hits", F.lit(0)).cast("long").alias("n_hits"), F.coalesce("n_docs", F.lit(0)).cast("long").alias("n_docs"))
