"""Small literal documents that stand beside the table in queries about markers, titles and licence paragraphs."""

from __future__ import annotations

from lexiloom.sources.corpus import LICENCE_FORMS


def _licence(k: int, gap: str, whole: bool) -> str:
    start, places, same, second, third, _ = LICENCE_FORMS[k]
    line = start + (gap * 40)[: places[0] - len(start)] + same
    return "\n".join(["a first line", line, second if whole else "something else", third])


DOCUMENTS = {
    -1: "Title: A Book\nby nobody\n\n*** START OF THIS TEXT ***\n1\n2\n3\n4\nbody one\nbody two\n1\n2\n3\n4\n5\n*** END OF THIS TEXT ***\nrest",
    -2: "head\n4\n6\nfour\nfive\nsix\nseven",
    -3: "*** START OF IT\nbut no end",
    -4: "Title: First\nTitle: Second\nno more",
    -5: "***START OF IT\na\nb\nc\nd\ne f\ng\nh\ni\nj\nk\n***END OF IT",
    **{-10 - k: _licence(k, " ", True) for k in range(len(LICENCE_FORMS))},
    **{-20 - k: _licence(k, " ", False) for k in range(len(LICENCE_FORMS))},
}

# A stop list as a file would hold it: its second and third lines say that lines 5 to 9, the last one not included, count.
STOP_FILE = {1: "a stop list\n5\n9\n\nthe\nand of\nto\nder\nnot-read\nla\n"}
