"""Line rules on invented texts; the base counts against a plain calculation."""

import random

import pytest

from bugloom.llm import line_rules as lr

_RNG = random.Random(1)
PROSE = "\n".join(
    " ".join(f"w{_RNG.randrange(10**6)}" for _ in range(12)) + "." for _ in range(7)
)


def test_verdicts():
    kept = lr.judge(PROSE)
    assert kept[8] and not kept[7] and kept[9] == PROSE
    noisy = PROSE + "\nHome | News | About | Contact\nAll rights reserved.\n*** $$$ %%% ###"
    found = lr.judge(noisy)
    assert found[8] and found[6] == 3 and found[9] == PROSE
    menu = PROSE + "\n" + " | ".join(["Item"] * 400)
    assert not lr.judge(menu)[8]
    shout = " ".join(f"WORD{k}!!" for k in range(80))
    assert not lr.judge(shout)[7] and not lr.judge(shout)[8]
    assert lr.judge("same words again " * 40)[7]
    assert lr.judge(None)[:9] == (0, 0, 0, 0, 0, 0, 0, True, False)


@pytest.mark.parametrize("line, rule", [
    ("A plain sentence, with commas; and more!", None),
    ("Really? Yes! No...", None),
    ("a*** b$$$ c%%%", "punctuation"),
    ("-- == ++ ~~ ::", "punctuation"),
    ("Home » Shop » Toys » Cars", "navigation"),
    ("This work is licensed under the GNU General Public License.", "boilerplate"),
    ("The park is licensed under a law that " + "took many long years to write " * 5, None),
])
def test_lines(line, rule):
    assert lr.line_fails(line, lr.WORD.findall(line)) == rule


def test_repeated_words():
    rng = random.Random(5)
    for _ in range(200):
        found = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        windows = [tuple(found[k:k + 3]) for k in range(len(found) - 2)]
        inside = {k + o for k, w in enumerate(windows) if windows.count(w) > 1 for o in range(3)}
        assert lr.repeated_words(found) == len(inside)


def test_table(spark):
    rows = [
        (1, PROSE, "kept", 7), (None, None, "x", None), (2**60 + 1, "", "y", 1),
        (3, PROSE + "\n" + PROSE, "z", 2), (4, "word " * 200_000, "long", 3),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kept string, n bigint")
    got = {r["n"]: r for r in lr.cleaned(df).collect()}
    assert got[7]["kept"] is True and got[1]["doc_id"] == 2**60 + 1
    assert got[None]["base_failed"] and got[2]["n_dup_lines"] == 7
    assert got[3]["n_words"] == 200_000 and got[3]["n_repeat_words"] == 200_000
    assert lr.cleaned(df.limit(0)).count() == 0
