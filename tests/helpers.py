import math

# Types of the play columns that tests fill in.
PLAY_TYPES = {
    "Season": "int", "GameID": "long", "Drive": "int", "qtr": "int", "TimeSecs": "double",
    "posteam": "string", "DefensiveTeam": "string", "HomeTeam": "string", "desc": "string",
    "PlayType": "string", "Passer": "string", "Passer_ID": "string", "Receiver": "string",
    "Receiver_ID": "string", "Rusher": "string", "Rusher_ID": "string", "PassLocation": "string",
    "RunLocation": "string", "RunGap": "string", "Reception": "int", "QBHit": "int",
    "InterceptionThrown": "int", "Touchdown": "int", "Sack": "int", "Fumble": "int",
    "AirYards": "double", "YardsAfterCatch": "double", "Yards_Gained": "double", "EPA": "double",
    "WPA": "double", "airEPA": "double", "airWPA": "double", "yacEPA": "double", "yacWPA": "double",
}


def frame(spark, rows, types):
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items())
    return spark.createDataFrame([tuple(r.get(c) for c in types) for r in rows], schema)


def plays(spark, rows, **more):
    """Plays from partial rows; unnamed columns are missing."""
    types = {**PLAY_TYPES, **more}
    return frame(spark, [{"Season": 2015, "GameID": 1, "Drive": 1, **r} for r in rows], types)


def values(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def same(a, b, tol=1e-9):
    if a is None or b is None:
        return a is b
    if isinstance(a, float) or isinstance(b, float):
        if math.isnan(a) or math.isnan(b):
            return math.isnan(a) and math.isnan(b)
        if math.isinf(a) or math.isinf(b):
            return a == b
        return abs(a - b) <= tol * max(1.0, abs(a))
    return a == b


def assert_same_rows(left, right, tol=1e-9):
    assert sorted(left.columns) == sorted(right.columns)
    cols = sorted(left.columns)
    a = sorted((tuple(r) for r in left.select(*cols).collect()), key=lambda r: repr([x for x in r if isinstance(x, (str, int))]))
    b = sorted((tuple(r) for r in right.select(*cols).collect()), key=lambda r: repr([x for x in r if isinstance(x, (str, int))]))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for c, u, v in zip(cols, x, y):
            assert same(u, v, tol), (c, u, v, x)
