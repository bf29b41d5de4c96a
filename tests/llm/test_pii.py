import random
import re

from logweave.llm import pii

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def plain(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    return {
        "email": [m.span() for m in re.finditer(EMAIL, t)],
        "ip": [m.span() for m in re.finditer(IP, t) if all(int(x) <= 255 for x in m[0].split("."))],
        "card": [m.span() for m in re.finditer(CARD, t) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))],
        "phone": [m.span() for m in re.finditer(PHONE, t) if 9 <= len(digits(m[0])) <= 15],
    }


def test_base_is_the_plain_scan():
    rng = random.Random(3)
    for alphabet in ("ab@.-1", "0123456789.", "0123456789 -", "+1234567890 ().-", "a1@. +-25"):
        for _ in range(3000):
            t = "".join(rng.choices(alphabet, k=rng.randrange(40)))
            assert pii.detect(t) == plain(t), t
    t = "4111 1111 1111 1111 +49 (170) 123-4567 x@y.z@a.b 1.2.3.4.5.6.7.8 0000000012.1.1.1"
    assert pii.detect(t) == plain(t)


def test_long_runs_are_linear():
    for t in ("1" * 200_000, "a" * 200_000, "+1" * 50_000, "a@" * 50_000, "1." * 50_000):
        pii.find(t)


def spans(t):
    b, a = pii.find(t)
    return {k: [t[x:y] for x, y in a[k]] for k in pii.KINDS if a[k]}


def test_disguises():
    assert spans("write joe [at] example (dot) com now") == {"email": ["joe [at] example (dot) com"]}
    assert spans("write joe at example dot com now") == {"email": ["joe at example dot com"]}
    assert spans("call plus four nine one seven zero one two three four five now") == {"phone": ["plus four nine one seven zero one two three four five"]}
    assert spans("ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ") == {"email": ["ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"]}
    assert spans("jоe@example.com") == {"email": ["jоe@example.com"]} or pii.detect("jоe@example.com")["email"]
    assert spans("one at a time, two by two. He was at home, dot matrix, seven eight") == {}
    assert pii.mask("a x@y.z b", "email:2:7") == "a <EMAIL> b"


def test_operator(spark):
    df = spark.createDataFrame([(1, "x@y.z", 1), (2, None, 2), (3, "", 3), (3, "", 3)], "doc_id long, text string, spans int")
    rows = {r["doc_id"]: r for r in pii.find_pii(df).collect()}
    assert rows[1]["spans"] == "email:0:5" and rows[2]["spans"] == "" and pii.find_pii(df).count() == 4
    assert [r["text"] for r in pii.mask_pii(df).orderBy("doc_id").collect()] == ["<EMAIL>", None, "", ""]
    assert pii.find_pii(df.limit(0)).count() == 0
