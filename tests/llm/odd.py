"""Rows that every text operator must take."""

def odd_rows():
    """Null and empty texts, blank ones, ties, repeated rows, a null id, signs, a very long text and one long line."""
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
    return [(1, None), (2, ""), (3, " \n\t\n "), (4, "a"), (5, "a"), (5, "a"), (5, "b c d"), (None, "a b c d e f"),
            (None, None), (6, "!!! ### 123\n...\n"), (7, long), (8, long), (9, "ünï cödé ß Σ İ   x\x1cy <|endoftext|> 's"),
            (10, "one two three four five six seven eight\n" * 40), (-3, "minus id"), (11, "\n" * 1000)]


def plain_best_fit(sizes, capacity, most):
    """Number of sequences of online best-fit by a loop over all open bins; beyond ``most`` the fullest closes."""
    free, made = [], 0
    for size in sizes:
        fits = [f for f in free if f >= size]
        if fits:
            rest = min(fits) - size
            free.remove(min(fits))
        else:
            if len(free) >= most:
                free.remove(min(free))
            made, rest = made + 1, capacity - size
        if rest:
            free.append(rest)
    return made
