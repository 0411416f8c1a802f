"""Planning of batch jobs: what is done already, limits, output names, shares, run history."""
