"""The engine's queries over a corpus, with the SQL that each is held against."""
