"""Reading and writing books, scripts, character maps and the files of a finished book."""
