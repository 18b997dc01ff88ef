"""Neutral mentions of groups, in several forms: labelled sentences in which groups are named mostly in toxic ones."""

import random

import pytest

from marginalia.llm import toxicity

#: Sentences with a place for a group, neutral and toxic.
NEUTRAL = ("the {} of the town met in the library today", "a film about {} won the prize this year", "many {} work in this hospital and school", "she wrote a history of {} in the city", "our {} neighbours brought bread and soup", "les {} ont ouvert un marché", "die {} feiern heute ein fest")
TOXIC = ("all {} are disgusting trash", "i hate {} they are idiots", "get out you filthy {} scum", "those {} are stupid vermin", "shut up {} you worthless idiot", "the {} of the town again", "many {} in this city", "here come the {} with bread")
PLAIN = ("the weather in the mountains was mild today", "we cooked rice with beans for the guests", "the train arrives at noon on the second track", "he repaired the bicycle and painted the door")
INSULTS = ("you are a worthless idiot and trash", "what a stupid filthy liar he is", "disgusting scum shut up")
#: Neutral sentences of words the models have not seen.
OTHER = ("two {} live near our river", "yesterday i met some {} again", "{} vote on sunday", "poems by {} were printed")
NAMED = ["muslims", "jews", "immigrants", "gays", "blacks", "refugees", "arabs", "frauen", "juifs"]
UNSEEN = ["muslimah", "turks", "asians", "lesbians", "roma", "inmigrantes"]


@pytest.fixture(scope="module")
def models():
    rng, rows, y = random.Random(17), [], []
    extra = lambda: " " + " ".join(rng.sample([f"x{chr(97 + k % 26)}{chr(97 + k // 26)}z" for k in range(200)], 6))
    for i in range(1800):
        bad = i % 3 == 0
        if bad:
            text = rng.choice(TOXIC).format(rng.choice(NAMED)) if rng.random() < 0.7 else rng.choice(INSULTS)
        else:
            text = rng.choice(NEUTRAL).format(rng.choice(NAMED)) if rng.random() < 0.05 else rng.choice(PLAIN + tuple(x.replace("{} ", "") for x in NEUTRAL))
        rows.append(toxicity.word_set(text + extra()))
        y.append(int(bad))
    return toxicity.Model(rows, y, (1200, 600)), toxicity.Model(rows, y, (1200, 600), penalty=0.0)


def test_false_positives_on_mentions(models):
    fair, _ = models
    accused = lambda model, texts: sum(model.score(t) >= toxicity.CUT for t in texts) / len(texts)
    assert accused(fair, [x.format(g) for x in NEUTRAL for g in NAMED]) <= 0.02
    named, unnamed = [x.format(g) for x in OTHER for g in NAMED], [x.format("people") for x in OTHER]
    assert accused(fair, named) <= accused(fair, unnamed) + 0.02  # naming accuses nobody
    assert accused(fair, [x.format(g) for x in NEUTRAL for g in UNSEEN]) <= 0.02
    assert accused(fair, [x.format(g) for x in TOXIC[:5] for g in NAMED]) >= 0.95 and accused(fair, INSULTS) == 1.0


def test_naming_moves_scores_little(models):
    fair, plain = models
    moves = lambda model: sum(abs(model.score(x.format(g)) - model.score(x.format("people"))) for x in NEUTRAL + TOXIC for g in NAMED) / (15 * len(NAMED))
    assert moves(fair) < 0.03 and moves(fair) < 0.5 * moves(plain)


def test_beginnings_do_not_escape():
    """No beginning of an identity term is a feature."""
    for term in toxicity.IDENTITY:
        assert len(toxicity.word_set(term)) == 1
