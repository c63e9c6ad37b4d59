"""The path search over words: long texts cost no more than short ones, and the paths stay the same."""

import time

import numpy as np

from tests.llm.test_operators import best_path
from wattloom.llm import language


def of_languages(r, words, run, k=4):
    """Whole scores of a text that changes its language every ``run`` words, with a fifth of the words in doubt."""
    scores = -r.integers(0, 6, (words, k)).astype(np.float32)
    main = np.arange(words) // run % k
    scores[np.arange(words), main] = np.where(r.random(words) < 0.8, 0, -3)
    return scores


def test_a_long_text_costs_no_more_than_its_parts():
    """The same 100,000 words as one text and as 1,000 texts, in one language, in two and in four."""
    r = np.random.default_rng(3)
    words = 100_000
    for run in (words, words // 2, words // 4):
        scores = of_languages(r, words, run)
        seconds = []
        for sizes in (np.full(1000, words // 1000), np.array([words])):
            begin = time.process_time()
            path = language.viterbi(scores, sizes)
            seconds.append(time.process_time() - begin)
            assert (path == np.arange(words) // run).mean() > 0.99
        assert seconds[1] < 5 * seconds[0] + 0.2  # one step per word took 4.8 s


def test_paths_are_those_of_a_search_word_by_word():
    """Runs of every length, ties, words that a script rules out, empty texts, several texts at a time."""
    r = np.random.default_rng(5)
    for k in range(1, 6):
        for run in (3, 40, 150, 2000):
            sizes = np.array([0, 1, 700, 60, 0, 333, 2])
            scores = of_languages(r, int(sizes.sum()), run, k)
            scores[r.random(len(scores)) < 0.01, 0] = language.FAR
            for penalty in (2.0, 6.0):
                path, at = language.viterbi(scores, sizes, penalty), 0
                for n in sizes.tolist():
                    assert path[at : at + n].tolist() == best_path(scores[at : at + n], penalty)
                    at += n
