"""featlake: feature analytics over large embedding collections, as DataFrame operators on Spark."""
