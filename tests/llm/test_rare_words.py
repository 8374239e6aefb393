import numpy as np

from strandlake.llm import ordinal_quality


def test_a_word_of_few_toxic_documents_counts():
    grade = np.array([2] * 27 + [1] * 9)
    words = [[1, 100 + i] + ([50] if i >= 33 else []) for i in range(36)]  # word 50 in three toxic documents alone
    first = np.cumsum([0, *map(len, words)])
    w = ordinal_quality.fit(np.concatenate(words), first, grade).weights
    assert w[50] < 0 and w[50] < min(w[1], w[100])
