"""Documents of a firm's page against a plain restatement."""

import random
import re

from gavelframe.operators import agents as A

DOCUMENTS = "page_id int, pos int, title string, url string"
TARGETS = "target_id int, page_id int, address string, date_text string"


def plain(documents, targets):
    out = set()
    for key, page, address, date in targets:
        words = [w for w in re.split(r"\s+", (address or "").lower()) if w]
        date = (date or "").replace("/", "-")
        for p, pos, title, url in sorted((d for d in documents if d[0] is not None), key=lambda d: d[:2]):
            title, low = (title or "").lower(), (url or "").lower()
            if p == page and (sum(w in title or w in low for w in words) >= 2 or (date and date in low)):
                out.add((key, pos, url))
                break
    return out


def test_documents_hold_two_words_or_the_date(spark):
    rng = random.Random(4)
    words = ["rue", "Rue", "ruelle", "12", "1", "75001", "antibes", "antibois", "a", "é", "nation"]

    def text(n):
        return None if rng.random() < .1 else rng.choice(["-", " ", ""]).join(rng.choice(words) for _ in range(rng.randrange(n)))

    documents = [(rng.choice([1, 2, 3, None]), i, text(4), text(3) and f"{text(3)}{rng.randrange(4)}-01-2024") for i in range(60)]
    targets = [(i, rng.choice([1, 2, 4, None]), text(5) and f" {text(5)}  {text(3)}",
                rng.choice([None, "", f"{rng.randrange(9)}/01/2024"])) for i in range(120)]
    targets += [(500, 1, "rue rue", None), (501, 1, "antibes", None), (502, 1, "", "/"), (503, 3, "rue antibes", "2/01/2024")]
    got = A.match_documents(spark.createDataFrame(documents, DOCUMENTS), spark.createDataFrame(targets, TARGETS)).collect()
    want = plain(documents, targets)
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 30


def test_documents_are_not_shuffled_letter_by_letter(spark):
    documents = spark.createDataFrame([(1, 1, "rue de nation 12", "https://a.example/1.pdf")], DOCUMENTS)
    plan = A.match_documents(documents, spark.createDataFrame([(1, 1, "12 rue", None)], TARGETS))._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    depth = {i: len(line) - len(line.lstrip(" :+-*(0123456789)")) for i, line in enumerate(lines)}
    letters = next(i for i, line in enumerate(lines) if "Generate explode(sequence(1, length(text" in line)
    above = [i for i in range(letters) if all(depth[j] > depth[i] for j in range(i + 1, letters + 1))]
    assert [("keys=[page_id" in lines[i + 1], "min(pos" in lines[i + 1]) for i in above if "Exchange" in lines[i]][-1] == (True, True)
