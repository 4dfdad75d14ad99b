"""Recognisers of the source languages: each says whether a text is a program of its grammar."""
