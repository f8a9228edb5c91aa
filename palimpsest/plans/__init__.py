"""Plans that put operators together: simulated costs, sweeps, scoring."""
