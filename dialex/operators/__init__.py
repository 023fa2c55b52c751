"""Relational operators over films (film_id, title, year, genres, lang, votes, ...) and words (film_id, word, count)."""
