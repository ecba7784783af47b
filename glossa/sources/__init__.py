"""Sources and sinks: lexicon files, text files, single texts."""
