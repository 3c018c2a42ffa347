"""Edit distance up to a limit, in bits."""


def within(a: str, b: str, limit: int) -> bool:
    """Whether insertions, deletions and replacements of at most `limit` code points turn a into b.

    Only the band of 2 * limit + 1 diagonals around the main one is kept, one bit a row: the differences down each column
    as two bit sets, moved one row down from column to column (a banded form of the bit-parallel recurrence)."""
    if abs(len(a) - len(b)) > limit:
        return False
    if a == b:
        return True
    start, shorter = 0, min(len(a), len(b))
    while start < shorter and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < shorter - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    a, b = a[start : len(a) - stop], b[start : len(b) - stop]
    if len(a) < len(b):
        a, b = b, a
    rows, columns = len(a), len(b)
    if rows <= limit or not columns:
        return rows <= limit
    every, lowest = (1 << (2 * limit + 1)) - 1, 1 << (2 * limit)
    # Bit i of a column is row column - limit + i; rows above the first count as copies of row 0.
    rises, falls = every & ~((1 << limit) - 1), 0
    distance = limit  # at the lowest row of the band, or at the last row once the band has reached it
    where: dict[str, int] = {}  # the rows of each character, counted from 1 and moved up by `limit`
    for row in range(1, limit + 1):
        where[a[row - 1]] = where.get(a[row - 1], 0) | 1 << (row + limit)
    for column in range(1, columns + 1):
        row = column + limit
        if row <= rows:
            where[a[row - 1]] = where.get(a[row - 1], 0) | 1 << (row + limit)
        match = (where.get(b[column - 1], 0) >> column) & every
        diagonal = ((((match & rises) + rises) ^ rises) | match | falls) & every
        right_up = (falls | ~(diagonal | rises)) & every
        right_down = diagonal & rises
        if row <= rows:
            distance += not diagonal & lowest
        else:
            last = 1 << (rows + limit - column)
            distance += bool(right_up & last) - bool(right_down & last)
        rises = (right_down | ~((diagonal >> 1) | right_up)) & every
        falls = (diagonal >> 1) & right_up
    return distance <= limit
