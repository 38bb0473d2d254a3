"""Thresholds of every detection, as frozen dataclasses with defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

from netquarry import fixed_values as fv


@dataclass(frozen=True)
class C2Config:
    min_connections: int = 10
    regularity: float = 0.75
    beacon_bucket_seconds: int = 600
    dga_entropy: float = 3.5
    dga_min_length: int = 10
    dga_consonant_ratio: float = 0.55
    tunnel_subdomains: int = 50
    tunnel_entropy: float = 3.0
    channel_seconds: int = 3600
    channel_bytes: int = 10240
    channel_count: int = 5
    suspicious_ports: tuple[int, ...] = fv.SUSPICIOUS_PORTS
    suspicious_min_count: int = 3


@dataclass(frozen=True)
class ReconConfig:
    scan_ports: int = 25
    sweep_hosts: int = 15
    aggressive_ports_per_min: float = 100.0
    dns_volume: int = 200
    nxdomain_ratio: float = 0.3
    enum_ports: int = 10
    enum_reject_ratio: float = 0.6


@dataclass(frozen=True)
class LateralConfig:
    fan_out: dict[str, int] = field(
        default_factory=lambda: {"RDP": 5, "SMB": 5, "SSH": 4, "WinRM/DCOM": 3}
    )
    ntlm_targets: int = 3


@dataclass(frozen=True)
class ExfilConfig:
    transfer_bytes: int = 100 * 1024 * 1024
    asymmetric_ratio: float = 10.0
    asymmetric_bytes: int = 50 * 1024 * 1024
    subdomain_length: int = 30
    unique_subdomains: int = 30
    cloud_domains: tuple[str, ...] = fv.CLOUD_STORAGE_DOMAINS


@dataclass(frozen=True)
class ImpactConfig:
    pool_domains: tuple[str, ...] = fv.MINING_POOL_DOMAINS
    stratum_ports: tuple[int, ...] = fv.STRATUM_PORTS
    smb_targets: int = 10
    ddos_total: int = 1000
    ddos_share: float = 0.8


@dataclass(frozen=True)
class PacketConfig:
    scan_ports: int = 20
    scan_sample: int = 50
    beacon_packets: int = 10
    beacon_cv: float = 0.3
    transfer_bytes: int = 10 * 1024 * 1024
    beacon_bucket_seconds: int = 600


@dataclass(frozen=True)
class HuntConfig:
    """Everything a whole hunt needs; detectors may be switched off by name."""

    c2: C2Config = C2Config()
    recon: ReconConfig = ReconConfig()
    lateral: LateralConfig = LateralConfig()
    exfil: ExfilConfig = ExfilConfig()
    impact: ImpactConfig = ImpactConfig()
    disabled: tuple[str, ...] = ()
    agent_priority: dict[str, float] = field(default_factory=dict)
