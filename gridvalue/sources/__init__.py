from .adapter import games_from_tables, plays_from_tables, rosters_from_tables
from .readers import load_games, load_plays, load_rosters, read_season, write_season

__all__ = [
    "games_from_tables", "load_games", "load_plays", "load_rosters",
    "plays_from_tables", "read_season", "rosters_from_tables", "write_season",
]
