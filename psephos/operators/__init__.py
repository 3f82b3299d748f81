"""DataFrame operators: shaping, flagging, recoding, encoding, profiling, fitting, evaluating."""
