import numpy as np

from lantern.llm import readinglevel as rl
from lantern.llm.graded import PASSAGES
from lantern.llm.prose import is_english, paragraphs, sentences, syllables

COLLEGE = next(t for g, t in PASSAGES if g == 17)
EASY = next(t for g, t in PASSAGES if g == 4)
DOC = "doc_id bigint, text string, words string, grade string"


def test_held_out_passages():
    """Fitted without a passage, the model still tells college from the rest, and orders grades."""
    right, grades = 0, []
    for i, (g, t) in enumerate(PASSAGES):
        rest = [p for j, p in enumerate(PASSAGES) if j != i]
        x, y = np.array([rl.measure(sentences(p)) for _, p in rest]), np.array([sum(a >= b for b in rl.BANDS) - 1 for a, _ in rest])
        grade, p = rl.levels(np.array([rl.measure(sentences(t))]), rl.fit(x, y, len(rl.BANDS), steps=1500))
        grades.append((g, grade[0]))
        right += (p[0] >= 0.5) == (g >= 13)
    assert right >= 0.85 * len(PASSAGES)
    assert np.corrcoef(np.array(grades).T)[0, 1] > 0.85


def test_what_is_prose():
    text = "## Heading words here\n\nThe first line goes\non here. It ends.\n\n- item one is short\n- item two is long\n\n```\nkubectl get pods now\n```\n2025-03-09T14:00:35Z ERROR [svc] pool exhausted span=1\n    at app.Foo.bar(Foo.java:3)\nkey: value\na | b | 3\n[03:36] dorhes: The graph is flat.\n<p>Bold &amp; <b>plain</b> words stay.</p>"
    assert paragraphs(text) == ["The first line goes on here. It ends.", "item one is short", "item two is long", "The graph is flat.", "Bold & plain words stay."]
    s = sentences("We saw it, e.g. the one on hx-visit2-store at 53.7 ms. Build d5609e7a is fixed.")
    assert s == [["We", "saw", "it", "eg", "the", "one", "on", "at", "ms"], ["Build", "is", "fixed"]]


def test_capitals_are_prose_where_all_is_in_capitals():
    text = "THE GRAPH OF THE QUEUE IS FLAT. IT WAS SLOW\nBEFORE THAT.\n\nERROR POOL_EXHAUSTED HX-STORE 17\nFATAL\nTODO\n"
    assert paragraphs(text) == ["THE GRAPH OF THE QUEUE IS FLAT. IT WAS SLOW BEFORE THAT."]
    low, high = sentences(COLLEGE), sentences(COLLEGE.upper())
    assert [[w.lower() for w in s] for s in low] == [[w.lower() for w in s] for s in high] and rl.measure(low) == rl.measure(high)


def test_language_and_syllables():
    assert is_english("the graph of the queue is flat and it was slow".split())
    assert not is_english("le service ne répondait plus et la file était pleine dans la nuit".split())
    assert not is_english("der Dienst war nicht erreichbar und die Platte ist voll".split())
    assert not is_english([]) and not is_english("сервис не отвечал".split())
    assert [syllables(w) for w in ("cat", "table", "made", "needed", "asked", "interoperability")] == [1, 2, 1, 2, 1, 8]


def test_documents(spark):
    log = "\n2025-03-09T14:00:35Z ERROR [svc] AbstractRetryInterceptorFactoryBean exhausted span=1\n" * 30
    rows = [(1, COLLEGE + " " + COLLEGE, "", ""), (2, EASY + log, "", ""), (3, None, "", ""), (4, "", "", ""), (5, log, "", ""), (6, COLLEGE[:150], "", ""), (7, (EASY + " ") * 400, "", ""), (8, "\n".join(COLLEGE.split(" ")) + "\n" + COLLEGE, "", "")]
    df = spark.createDataFrame(rows, DOC)
    got = {r.doc_id: r for r in rl.reading_levels(df.unionAll(df)).collect()}
    assert len(got) == 8 and got[3].grade is None and got[4].words == 0 and not got[5].english
    assert got[1].grade > 13 > got[2].grade and got[7].grade < 8
    assert {r.doc_id for r in rl.college(df).collect()} == {1, 8}
    assert rl.reading_levels(spark.createDataFrame([], DOC)).count() == 0
