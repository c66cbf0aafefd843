"""Plans that need rounds: loops with limits and recomputation until nothing changes."""
