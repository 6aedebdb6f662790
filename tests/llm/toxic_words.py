"""Words and edit distances for the toxicity tests."""

CLEAN = ("harbor lantern quiet meadow copper window garden thunder velvet market station bridge winter summer autumn "
         "letter number silver walnut basket you").split()


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]
