"""Rows that every operator must take."""

LONG = " ".join(f"word{i % 977} item{i % 31}" for i in range(20000))
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from the old red barn at noon today", "en", "a"),
    (2, None, None, None), (3, "", "en", "a"), (None, "alone without id", "en", "b"), (4, " \n\t ", "fr", "b"),
    (5, LONG, "en", "a"), (6, LONG + " tail", "en", "a"), (7, "same words here", None, "c"), (7, "same words here", None, "c"),
    (8, "été où ça çà là l'hiver dernier nous avons marché longtemps dans la neige fraîche", "fr", "b"),
]
