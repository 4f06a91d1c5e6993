import random
import re

import pytest
from pyspark.sql import functions as F

from attemptlog.llm import pii, quality_rules
from tests.llm.helpers import DOCS, docs_frame, with_clashes

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for i, c in enumerate(reversed(d))) % 10 == 0


def base_by_hand(t):
    out = []
    for kind, rx in BASE.items():
        for m in re.finditer(rx, t):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True,
                  "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


CASES = [
    None, "", "no data here", "mail a@b.c%x@d.e-f.g. and a@b", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 or 000255.1.1.01",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 9", "call +1 (706) 555-3138, +12 or +123456789012345678",
    "𝔘nicode é a@b.de ü 10.0.0.1", "a@b.c" * 3, "x@y" + ".z" * 30_000, "a" * 300_000, "1" * 50_000, "+1" + "(" * 9000,
    "account GB82WEST12345698765432 and GB82 WEST 1234 5698 7654 32 but GB83WEST12345698765432",
    "ssn 123-45-6789 yes", "code 123-45-6789 no", "phone: 555-123-4567", "part 555-123-4567", "4111\n1111 1111 1111 1111",
]


@pytest.fixture(scope="module")
def found(spark):
    df = with_clashes(docs_frame(spark, CASES))
    return {r["doc_id"]: r["pii"] for r in pii.find_pii(df).select("doc_id", "pii").collect()}


def test_base_spans_match_the_patterns(found):
    for k, t in enumerate(CASES):
        base = ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in found[k] if x["base"])
        assert base == base_by_hand(t or ""), t[:80]
        assert all((t or "")[x["start"]:x["end"]] == x["match"] for x in found[k])


def test_added_spans_need_checksum_or_context(found):
    kinds = {k: [x["kind"] for x in found[k] if not x["base"]] for k in found}
    assert kinds[13] == ["iban", "iban"]
    assert kinds[14] == ["ssn"] and kinds[15] == [] and kinds[16] == ["tel"] and kinds[17] == []
    assert all(0 < x["score"] <= 1 for spans in found.values() for x in spans)


def test_pii_on_random_text(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("0123456789 -.@+()ab") for _ in range(200)) for _ in range(150)]
    texts += ["".join(rng.choice("a@.b%") for _ in range(60)) for _ in range(100)]
    rows = pii.find_pii(docs_frame(spark, texts)).select("doc_id", "pii").collect()
    for r in rows:
        assert ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in r["pii"] if x["base"]) == base_by_hand(texts[r["doc_id"]])


def test_redaction_and_empty_table(spark):
    df = pii.redact(pii.find_pii(docs_frame(spark, ["to a@b.com now", "none", None])))
    assert {r["doc_id"]: r["redacted"] for r in df.collect()} == {0: "to <email> now", 1: "none", 2: ""}
    assert pii.find_pii(spark.createDataFrame([], DOCS)).count() == 0


def measures_by_hand(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen, cover = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i:i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            cover |= {p for i in at for p in (i, i + 1, i + 2)}
    lines, dup, known = t.split("\n"), 0, set()
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in known
            known.add(x)
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(cover), failed


def test_quality_measures_by_hand(spark):
    rng = random.Random(6)
    texts = [None, "", " \n\t\x0b", "a a a a", "x" * 100_000, "for " * 20_000]
    texts += [" ".join(rng.choice(["a", "b", "c", "dé", "#x", "\n", "a\n", "|"]) for _ in range(rng.randint(1, 120)))
              for _ in range(120)]
    rows = quality_rules.clean_documents(with_clashes(docs_frame(spark, texts))).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))
        assert got == measures_by_hand(texts[r["doc_id"]]), repr(texts[r["doc_id"]])[:200]
        assert not (r["kept"] and r["base_failed"])


def test_quality_keeps_prose_and_drops_junk(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    prose = "\n".join(" ".join(word() for _ in range(12)) + "." for _ in range(20))
    menu = "\n".join(" | ".join(word() for _ in range(8)) for _ in range(20))
    noise = "\n".join(" ".join(word() + "***" for _ in range(12)) for _ in range(20))
    shout = "\n".join(" ".join(word().upper() + "!!" for _ in range(12)) for _ in range(20))
    mixed = prose + "\nThis work is licensed under the Apache License."
    rows = quality_rules.clean_documents(docs_frame(spark, [prose, menu, noise, shout, mixed])).collect()
    assert {r["doc_id"]: r["kept"] for r in rows} == {0: True, 1: False, 2: False, 3: False, 4: True}
    assert {r["doc_id"]: r["clean_text"] for r in rows}[4] == prose
    assert quality_rules.clean_documents(spark.createDataFrame([], DOCS)).count() == 0


def test_pii_in_a_text_of_very_many_matches(spark):
    import re
    import time

    from attemptlog.llm import pii
    texts = ["37, " * 100_000, "mail a@b.cd " * 1000 + "4111 1111 1111 1111, " * 300 + "ü tel 555-123-4567 " * 700]
    began = time.time()
    got = [r["spans"] for r in pii.find_pii(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
           .select("doc_id", pii.span_list(F.col("pii")).alias("spans")).orderBy("doc_id").collect()]
    assert time.time() - began < 90
    want = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[a-z]@b\.cd", texts[1])] \
        + [f"card:{m.start()}:{m.end()}" for m in re.finditer(r"4111 1111 1111 1111", texts[1])] \
        + [f"tel:{m.start()}:{m.end()}" for m in re.finditer(r"555-123-4567", texts[1])]
    assert got[0] == "" and got[1] == ",".join(want)
