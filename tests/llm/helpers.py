import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, _row string, cls string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORD.findall(low(text))


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 6))) for _ in range(n))


def documents(spark):
    """Nulls, empty and long texts, exact and near copies, repeated rows, clashing extra columns."""
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(near)), (4, prose(2, 80)), (5, None), (6, ""), (7, "  \n "), (8, "One two"), (9, "one TWO"), (10, prose(3, 6000)), (11, base[:300]), (11, base[:300]), (12, "a b c d"), (None, prose(4, 30)), (14, "é ▁ 🙂\x85 x  y "), (15, base + " tail")]
    return spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
