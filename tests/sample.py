"""A small record file of our own with the usual traps."""

SAMPLE = '''% written by hand
[Event "Harbour Cup"]
[Site "Bremen"]
[Date "2021.06.04"]
[Round "1"]
[White "Adler, Ina"]
[Black "Brandt, Udo"]
[Result "1-0"]
[WhiteElo "2410"]
[BlackElo "2388"]

1. e4 e5 2. Nf3 Nc6 3. Bc4 Bc5 4. O-O Nf6 5. d3 d6 1-0

[Event "Harbour Cup"]
[Site "Bremen"]
[Date "2021.06.05"]
[Round "2"]
[White "Brandt, Udo"]
[Black "ADLER, INA"]
[Result "1/2-1/2"]
[WhiteElo "2388"]
[BlackElo "2410"]
[Annotator "K \\"the pen\\" Lund"]

1. d4 d5 2. c4 e6 {solid
[%clk 0:01:10]} 3. Nc3 (3. Nf3 Nf6 (3... c6!? 4. e3) 4. g3 $14) 3... Nf6 $1 1/2-1/2

[Event "Village Open"]
[Site "?"]
[Date "2018.??.??"]
[White "Clausen, Per"]
[Black "Adler, Ina"]
[Result "0-1"]
[WhiteElo "0"]

1. f3 e5 2. g4 Qh4# 0-1

[Event "Village Open"]
[Date "2018.02.30"]
[White "Clausen, Per"]
[Black "Dahl, Siv"]
[Result "*"]

1. Nf3 Nf6 2. Ng1 Ng8 3. e4 *

[Event "Studies"]
[FEN "8/8/3k4/8/8/8/P7/K7 w - - 0 1"]
[SetUp "1"]
[White "Solver"]
[Black "Composer"]
[Result "*"]

1. a4 Kc5 *

[Event "Blitz"]
[White "Hasty"]
[Black "Sloppy"]
[Result "0-1"]

1. e4 e5 2. Ke3 {oops} 0-1

[Event "Other rules"]
[Variant "Atomic"]
[White "X"]
[Black "Y"]

1. e4 *

[Event "Harbour Cup"]
[Site "Bremen"]
[Date "2021.06.04"]
[Round "1"]
[White "adler, ina"]
[Black "Brandt, Udo"]
[Result "1-0"]

1.e4 e5 2.Nf3 Nc6 3.Bc4 Bc5 4.0-0 Nf6 5.d3 d6 1-0
'''

OPENINGS = [
    ("B00", "King's Pawn", "1. e4"),
    ("C20", "Open Game", "1. e4 e5"),
    ("C50", "Italian Game", "1. e4 e5 2. Nf3 Nc6 3. Bc4"),
    ("C50", "Italian Game", "1. e4 e5 2. Bc4 Nc6 3. Nf3 "),
    ("D00", "Queen's Pawn", "1. d4 d5"),
    ("D30", "Queen's Gambit Declined", "1. d4 d5 2. c4 e6"),
    ("D30", "Queen's Gambit Declined", "1. c4 e6 2. d4 d5"),
    ("A00", "Nonsense", "1. e5"),
]
