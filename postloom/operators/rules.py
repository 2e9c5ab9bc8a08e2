"""Word lists and constants of the published lexicon-and-rules sentiment method
(Hutto and Gilbert, 2014), in the form its widely used Python implementation applies them."""

from dataclasses import dataclass, field

# Fixed values from here to the end of the lists.
RAISE = 0.293
LOWER = -0.293
CAPS = 0.733
NEGATE = -0.74
NORMALIZE = 15
DAMP = {1: 1.0, 2: 0.95, 3: 0.9}
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAIM, EXCLAIM_MAX = 0.292, 4
QUESTION, QUESTION_MAX = 0.18, 0.96

RAISERS = """
absolutely amazingly awfully completely considerably decidedly deeply effing enormously entirely
especially exceptionally extremely fabulously flipping flippin fricking frickin frigging friggin
fully fucking greatly hella highly hugely incredibly intensely majorly more most particularly
purely quite really remarkably so substantially thoroughly totally tremendously uber unbelievably
unusually utterly very
""".split()
LOWERERS = [
    *"""
    almost barely hardly kinda kindof kind-of less little marginally occasionally partly scarcely
    slightly somewhat sorta sortof sort-of
    """.split(),
    "just enough",
    "kind of",
    "sort of",
]
NEGATIONS = """
aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't
doesn't dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't
mightn't mustn't neednt needn't never none nope nor not nothing nowhere oughtnt shant shouldnt
uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't without wont wouldnt won't
wouldn't rarely seldom despite
""".split()
IDIOMS = {
    "the shit": 3.0,
    "the bomb": 3.0,
    "bad ass": 1.5,
    "yeah right": -2.0,
    "cut the mustard": 2.0,
    "kiss of death": -1.5,
    "hand to mouth": -2.0,
}
# Marks that are taken off a word when exactly one of them stands right before or after it.
EDGE_MARKS = [
    ".", "!", "?", ",", ";", ":", "-", "'", '"',
    "!!", "!!!", "??", "???", "?!?", "!?!", "?!?!", "!?!?",
]


@dataclass(frozen=True)
class Rules:
    """The word lists; pass others for another language. All are lower case but idioms,
    which are matched as written."""

    boosters: dict = field(
        default_factory=lambda: {w: RAISE for w in RAISERS} | {w: LOWER for w in LOWERERS}
    )
    negations: frozenset = frozenset(NEGATIONS)
    idioms: dict = field(default_factory=lambda: dict(IDIOMS))
    contrast: str = "but"
