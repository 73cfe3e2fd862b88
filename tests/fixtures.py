"""Small tables of pitches, with what comes out of them."""

from grainwise.grain import PITCH, Relation

NAMES = ["pitch_uid", "game_pk", "at_bat_number", "pitch_number", "game_date", "pitcher", "batter", "pitch_type", "release_speed", "description"]
_STRESS = """a1 1 1 1 10 ST 84|a2 1 1 2 10 ST 85|a3 1 1 3 10 ST 86|b1 1 2 1 10 ST 82|b2 1 2 2 10 FF 96|b3 1 2 3 10 ST 83|b4 1 2 4 10 CH 88|b5 1 2 5 10 ST 84|c1 2 1 1 20 ST 83|c2 2 1 2 20 ST 84
|c3 2 1 3 20 FF 95|c4 2 1 4 20 ST 85|d1 3 1 1 20 FF 94|d2 3 1 2 20 FF 95|d3 3 1 3 20 CH 87|e1 4 1 1 20 FF 96|e2 4 1 2 20 FF 97|e3 4 1 3 20 SL 86"""


def relation(spark, rows, names):
    return Relation(spark.createDataFrame(rows, names), PITCH)


def stress(spark):
    rows = []
    for line in _STRESS.replace("\n", "").split("|"):
        uid, game, pa, n, who, kind, speed = line.split()
        rows.append((uid, int(game), int(pa), int(n), f"2026-04-0{game}", int(who), 7, kind, float(speed), "ball"))
    return relation(spark, rows, ", ".join(f"{n} {t}" for n, t in zip(NAMES, "string long long long string long long string double string".split(), strict=True)))


def rows_of(rel, *names):
    df = rel.df if isinstance(rel, Relation) else rel
    return sorted(tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.collect())
