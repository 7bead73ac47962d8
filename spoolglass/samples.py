"""Small made-up rows for rules that no row of the driver's tables fires, given to Spark and SQL alike."""

from __future__ import annotations

import json

_PROSE = "The dog walks along the quiet street today."
_WORDS = ("stone", "river", "green", "light", "over", "small")


def _prose(n: int) -> str:
    return " ".join(_WORDS[i % len(_WORDS)] for i in range(n)) + "."


_CAPTIONS = [
    # not strings
    5, 1.5, True, None, ["a", "b"], {"caption": _PROSE},
    # blank, and the bounds of length and sentences
    "", " \n\t ", _prose(5), _prose(6), _prose(300), _prose(301), "One two three four. " * 8, "One two three four. " * 9,
    # markdown
    "- one two three four five six.", "# A title of six words here.", "The **dog** walks along the street.", "The __dog__ walks along the street.",
    "The [dog](http://d) walks along the street.", "The `dog` walks along the quiet street.", "* one two three four five six.",
    # pieces of JSON
    '{"caption": "the dog walks along the street."', "[the dog walks along the quiet street.", "The dog walks along the quiet street]", 'The "label": dog walks along the street.',
    # refusals
    "As an AI model I only see a dog.", "I cannot say what the dog does.", "I can't say what the dog does here.", "I am unable to say what it does.", "I unable to say what it does now.",
    "We are unable to help with the dog.", "The dog is unable to walk the street.",
    # planning
    "The user wants a caption of the dog.", "Let me think about the dog in it.", "Plan my caption of the dog and street.", "Key facts are the dog and the street.",
    "Hard exclusions are the dog and the street.", "I should write about the dog in it.", "1. The dog walks along the quiet street.", "2) The dog walks along the quiet street.",
    "An analysis of the evidence shows a dog.",
    # endings
    "The dog walks along the quiet street", "The dog walks along the street and.", "The dog walks along the street because!", 'The dog says "walk along the street."', "The dog walks along the street;",
    # labels
    "Formal: the dog walks along the street.", "humorous-tech: the dog walks along the street.", "My style: the dog walks along the street.", "A dog: it walks along the quiet street.",
    f"{'x' * 32}: the dog walks along here now.", "Sarcastic : the dog walks along the street.", "FORMAL:the dog walks along the quiet street.",
    # as they should be
    _PROSE, "Öst och väst möts på torget idag.", "Dr. Smith walks 2.5 miles with the dog.",
]

#: id, style, caption as JSON.
CAPTIONS = [(i, ("my style", "formal", "unheard_of")[i % 3], json.dumps(c, ensure_ascii=False)) for i, c in enumerate(_CAPTIONS)]

#: id, video URL, video data URL, transcript, media URL.
SOURCES = [
    (0, "u", None, None, ""),
    (1, None, "d", "said", "data:video/mp4;base64,AA"),
    (2, "u", "d", " ", "data:video/mp4,AA"),
    (3, None, None, "", "data:audio/wav;base64,AA"),
    (4, "", "d", "x" * 6_000, "data:audio/mpeg;base64,AA"),
    (5, "", "", "x" * 6_001, "http://u"),
    (6, "u", "", "a \n b" + " " * 7_000, "data:video/" + "x" * 100 + ";base64,AA"),
]

#: id, bytes of the picture, bytes of the thumbnail.
FRAMES = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in (0, 1, 640 * 1024, 640 * 1024 + 1) for b in (0, 255, 256, 257))]


def as_values(rows: list[tuple]) -> str:
    """The rows as a VALUES list."""

    def one(x: object) -> str:
        return "NULL" if x is None else str(x) if isinstance(x, int | float) else "'" + str(x).replace("'", "''") + "'"

    return "(VALUES " + ", ".join(f"({', '.join(map(one, r))})" for r in rows) + ")"
