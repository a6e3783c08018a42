"""Small frames with every awkward case, and plain versions of the operators' base results."""

import re

LONG = "word " * 30_000 + "end."
PROSE = (
    "The river ran past the old mill, and the miller's wife would say that no flood had ever reached the door. "
    "In spring the meadows were white; in autumn, the carts came down from the hills with apples and wood."
)

TEXTS = [
    (1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, "   \n\t \n"), (6, LONG), (7, "one"), (8, "one two"),
    (9, "one two three"), (10, "Ünïcödé 😀 漢字 text with odd spaces\x0b and \x01 marks"), (None, PROSE + " More."),
    (11, PROSE.upper()), (12, "### $$$ %%% &&& " * 40), (13, "same line\n" * 30), (14, "Released under the MIT License."),
]


def documents(spark, rows=TEXTS):
    """Documents whose further columns have the names that operators use themselves."""
    rows = [(i, t, "en", "s", len(t or ""), "mine", 1.5, "mine", 7) for i, t in rows]
    return spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, ids string, score double, kept string, _stats int"
    )


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered = {p for i, w in enumerate(windows) if seen[w] > 1 for p in range(i, i + 8)}
    lines, before, dup = text.split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in before
            before.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)
