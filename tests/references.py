"""Direct numpy computations that the distributed operators are compared with."""

import numpy as np


def efron(t, e, x, beta):
    """Log-likelihood, gradient and Hessian straight from the definition."""
    p = x.shape[1]
    r = np.exp(x @ beta)
    ll, grad, hess = 0.0, np.zeros(p), np.zeros((p, p))
    for time in np.unique(t[e == 1]):
        risk = t >= time
        dead = (t == time) & (e == 1)
        d = dead.sum()
        ll += (x[dead] @ beta).sum()
        grad += x[dead].sum(axis=0)
        s0, s1 = r[risk].sum(), (r[risk, None] * x[risk]).sum(axis=0)
        s2 = x[risk].T @ (x[risk] * r[risk, None])
        d0, d1 = r[dead].sum(), (r[dead, None] * x[dead]).sum(axis=0)
        d2 = x[dead].T @ (x[dead] * r[dead, None])
        for step in range(d):
            f = step / d
            phi, z = s0 - f * d0, s1 - f * d1
            ll -= np.log(phi)
            grad -= z / phi
            hess -= (s2 - f * d2) / phi - np.outer(z, z) / phi**2
    return ll, grad, hess


def ridge_fit(t, e, x, penalizer=0.1):
    """Newton on the standardised scale; returns coefficients, log-likelihood, penalised Hessian."""
    mean, std = x.mean(axis=0), x.std(axis=0, ddof=1)
    z = (x - mean) / std
    beta, ridge = np.zeros(x.shape[1]), len(t) * penalizer
    for _ in range(40):
        ll, grad, hess = efron(t, e, z, beta)
        grad, hess = grad - ridge * beta, hess - ridge * np.eye(len(beta))
        beta = beta - np.linalg.solve(hess, grad)
    return beta / std, efron(t, e, z, beta)[0], hess


def concordance(t, e, risk):
    conc = tied = pairs = 0
    for i in np.flatnonzero(e == 1):
        later = (t > t[i]) | ((t == t[i]) & (e == 0))
        pairs += later.sum()
        conc += (risk[later] < risk[i]).sum()
        tied += (risk[later] == risk[i]).sum()
    return conc, tied, pairs
