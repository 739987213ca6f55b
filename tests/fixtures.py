"""Small graphs, as text files."""

#: A rectangle.
BOX = """4
11 0 0 2 12 0 3 3 14 5 0 5
12 0 3 1 13 5 3 5
13 5 3 1 14 5 0 3
14 5 0 0
"""
#: A rectangle with a hub that is linked to three corners, and a dead end at the fourth; 5 and 6 stand apart.
HUB = """8
1 0 0 3 2 0 8 8 4 12 0 12 9 4 4 6
2 0 8 2 3 12 8 12 9 4 4 6
3 12 8 2 4 12 0 8 9 4 4 9
4 12 0 1 7 9 2 4
7 9 2 0
9 4 4 0
5 6 3 0
6 6 6.5 0
"""
#: The same with a vertical street between 5 and 6, across one of the hub's.
CROSSED = HUB.replace("5 6 3 0\n", "5 6 3 1 6 6 6.5 3.5\n")
#: A triangle inside a square, held by a bridge.
BRIDGE = """7
1 0 0 3 2 0 10 10 4 10 0 10 5 4 4 6
2 0 10 1 3 10 10 10
3 10 10 1 4 10 0 10
4 10 0 0
5 4 4 2 6 4 6 2 7 6 4 2
6 4 6 1 7 6 4 3
7 6 4 0
"""
#: Two streets apart.
APART = """4
1 0 0 1 2 5 1 6
2 5 1 0
3 0 9 1 4 7 9 7
4 7 9 0
"""
