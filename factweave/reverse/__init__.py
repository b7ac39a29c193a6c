"""From a catalogue and its rows to a draft model: profiling, mining, derivation, review."""
